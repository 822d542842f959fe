"""All queries of this package and their SQL twins."""

from boxlake.plans import curation, duplicates, evaluation, formats, geometry, masks, pixels, small, streams

QUERIES = evaluation.Q | curation.Q | geometry.Q | formats.Q | pixels.Q | masks.Q | duplicates.Q | streams.Q | small.Q
ORACLES = evaluation.SQL | curation.SQL | geometry.SQL | formats.SQL | pixels.SQL | masks.SQL | duplicates.SQL | streams.SQL | small.SQL
