"""Vector entries from JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types of JSON values as the variant functions name them, by the field of a tagged value that holds them.
_TAGGED = """
    transform_values(coalesce(m, map()), (k, v) -> if(
        schema_of_variant(v) rlike '^(STRING|BOOLEAN|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$',
        named_struct(
            's', if(schema_of_variant(v) = 'STRING', cast(v as string), null),
            'd', if(schema_of_variant(v) rlike '^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$', cast(v as double), null),
            'b', if(schema_of_variant(v) = 'BOOLEAN', cast(v as boolean), null)),
        raise_error(concat('no metadata value under ', k))))
"""


def entries_frame(lines: DataFrame) -> DataFrame:
    """Rows (id, vec, meta, pos) from a text column ``value``: an entry ``{id, vector, metadata}`` a line, or a batch.

    Numbers of any kind are doubles; null, lists and objects as metadata values fail the query. Lines that are no JSON
    fail too. pos orders a file's entries: later ones win.
    """
    at = lines.select(F.parse_json("value").alias("j"))
    many = F.expr("coalesce(try_variant_get(j, '$.entries', 'array<variant>'), array(j))")
    each = at.select(F.explode(many).alias("e"))
    wide = each.select(
        F.expr("variant_get(e, '$.id', 'bigint')").alias("id"), F.expr("variant_get(e, '$.vector', 'array<float>')").alias("vec"),
        F.expr("variant_get(e, '$.metadata', 'map<string,variant>')").alias("m"), F.monotonically_increasing_id().alias("pos"),
    )
    return wide.select("id", "vec", F.expr(_TAGGED).alias("meta"), "pos")
