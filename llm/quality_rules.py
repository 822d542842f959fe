"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Each text gets a few statistics.  Fixed cut-offs are replaced by fences taken
from quantile sketches: KLL sketches are built per language and source with a
map-side partial aggregate, merged to the language and to the whole table, and
a group with fewer than ``min_rows`` rows uses the next wider sketch.  The
fences (one row per language and source) are joined back and filter the rows.

Edge cases: a null text has no words and fails the base rule; null language or
source form a group of their own; an empty table gives no rows; repeated rows
are judged each; a text of any length is judged whole; a value equal to a fence is
inside it; columns of the input that clash with the result are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import let, saved, table

GAP = r"[\x20\x09-\x0D]+"
#: statistic, lower fence used, slack added beyond the fences
RULES = (("symbol_ratio", False, 0.25), ("dup_line_ratio", False, 0.3), ("repeat_ratio", False, 0.1), ("word_length", True, 1.0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda x: x != "")


def repeated_words(w: Column, k: int = 5) -> Column:
    """Words inside k-word windows that the array holds twice or more."""

    def heavy(h: Column) -> Column:
        def places(s: Column) -> Column:
            twice = F.filter(s, lambda e, j: (F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"]))
            return F.sort_array(F.transform(twice, lambda e: e["i"]))

        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            let(by_hash, places),
            start,
            lambda a, i: F.struct((i + k).alias("end"), (a["n"] + i + k - F.greatest(i, a["end"])).alias("n")),
            lambda a: a["n"],
        )

    window = lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - k), window)
    none = F.lit(0).cast("long")
    return F.when(F.size(w) < k, none).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(heavy(h))))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        "doc_id", F.col("lang").alias("lang"), F.col("source").alias("source"),
        of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    ).select("doc_id", "lang", "source", "w.*", "l.*", "n_symbols")


def thresholds(stats: DataFrame, sketch_k: int = 4096, min_rows: int = 100) -> DataFrame:
    """lang, source and the fences lo_*, hi_* of every rule, from merged quantile sketches."""
    names = [r[0] for r in RULES]
    fine = stats.where("n_words > 0").groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(m, sketch_k).alias(m) for m in names))
    merged = lambda df, tag: df.agg(F.sum("n").alias(f"n_{tag}"), *(F.kll_merge_agg_double(m, sketch_k).alias(f"{m}_{tag}") for m in names))
    by_lang, total = merged(fine.groupBy("lang"), "lang"), merged(fine.groupBy(), "all")
    wide = fine.join(by_lang.withColumnRenamed("lang", "lang_of"), F.col("lang").eqNullSafe(F.col("lang_of"))).crossJoin(F.broadcast(total))  # total is one row

    def quantile(m: str, q: float) -> Column:
        pick = F.when(F.col("n") >= min_rows, F.col(m)).when(F.col("n_lang") >= min_rows, F.col(f"{m}_lang")).otherwise(F.col(f"{m}_all"))
        return F.kll_sketch_get_quantile_double(pick, F.lit(q))

    out = wide.select("lang", "source", *(quantile(m, q).alias(f"q{int(100 * q)}_{m}") for m in names for q in (0.25, 0.75)))
    fences = []
    for m, low, slack in RULES:
        q1, q3 = F.col(f"q25_{m}"), F.col(f"q75_{m}")
        fences.append((q3 + 3.0 * (q3 - q1) + slack).alias(f"hi_{m}"))
        fences.append((q1 - 3.0 * (q3 - q1) - slack if low else F.lit(-1.0)).alias(f"lo_{m}"))
    return out.select(F.col("lang").alias("lang_of"), F.col("source").alias("source_of"), *fences)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base statistics, base_failed and kept of every row of docs(doc_id, text, lang, source)."""
    n = F.col("n_words").cast("double")
    stats = saved(statistics(docs), "statistics").select(  # narrow; the texts are read once
        "*", F.try_divide("n_symbols", n).alias("symbol_ratio"), F.try_divide("n_dup_lines", F.col("n_lines").cast("double")).alias("dup_line_ratio"),
        F.try_divide("n_repeat_words", n).alias("repeat_ratio"), F.try_divide("word_chars", n).alias("word_length"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.lit(True)
    for m, _, _ in RULES:
        inside = inside & F.col(m).between(F.col(f"lo_{m}"), F.col(f"hi_{m}"))
    limits = thresholds(stats)
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("lang_of")) & F.col("source").eqNullSafe(F.col("source_of")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_Q = ", ".join(f"quantile_disc({m}, {q}) AS q{int(100 * q)}_{m}" for m, _, _ in RULES for q in (0.25, 0.75))
_PICK = ", ".join(f"CASE WHEN f.n >= 100 THEN f.q{q}_{m} WHEN l.n >= 100 THEN l.q{q}_{m} ELSE a.q{q}_{m} END AS q{q}_{m}" for m, _, _ in RULES for q in (25, 75))
_IN = " AND ".join(f"s.{m} <= t.q75_{m} + 3e0 * (t.q75_{m} - t.q25_{m}) + {slack}::DOUBLE" + (f" AND s.{m} >= t.q25_{m} - 3e0 * (t.q75_{m} - t.q25_{m}) - {slack}::DOUBLE" if low else "") for m, low, slack in RULES)

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1) GROUP BY rid),
x AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines FROM d),
b AS (SELECT d.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN x USING (rid) LEFT JOIN r USING (rid)),
s AS (SELECT *, n_symbols / nullif(n_words, 0)::DOUBLE AS symbol_ratio, n_dup_lines / nullif(n_lines, 0)::DOUBLE AS dup_line_ratio,
             n_repeat_words / nullif(n_words, 0)::DOUBLE AS repeat_ratio, word_chars / nullif(n_words, 0)::DOUBLE AS word_length FROM b),
f AS (SELECT lang, source, count(*) AS n, {_Q} FROM s WHERE n_words > 0 GROUP BY ALL),
l AS (SELECT lang, count(*) AS n, {_Q} FROM s WHERE n_words > 0 GROUP BY ALL),
a AS (SELECT {_Q} FROM s WHERE n_words > 0),
t AS (SELECT f.lang, f.source, {_PICK} FROM f JOIN l ON f.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce({_IN}, false) AS kept
FROM s LEFT JOIN t ON s.lang IS NOT DISTINCT FROM t.lang AND s.source IS NOT DISTINCT FROM t.source
"""
