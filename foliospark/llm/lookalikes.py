"""Problem 6 on DataFrames: one consistent form for texts that look alike.

A worker maps the values whose characters are suspicious (:mod:`gate`); an
ordinary value is its own mapped form.  All values fall into classes in SQL by
their mapped form under an accent-sensitive Unicode collation, which also holds
canonically equivalent spellings equal.  A class's canonical member is the
spelling most of its ordinary values have, or where it has none the most frequent
mapped form (ties: the smallest); it is joined back.  Ordinary values in no class
with a flagged one change nothing, so only their collation hashes meet the
classes and their texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import gate, lookalike_chars
from .common import fields, spool
from .encoding_repair import FIELDS, read_fields


def mapped_fields(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, field, value, mapped) of the fields with stand-ins; value is without encoding damage.  Null fields have none."""
    src = read_fields(df, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, names, values, mapped, ids = [], [], [], [], b.column(0)
            for name, column in zip(FIELDS, b.columns[1:]):
                for i, v in enumerate(column.to_pylist()):
                    if v and not gate.ordinary(v):
                        clean = gate.restored(v)
                        if gate.lookalike_suspect(clean):
                            m = lookalike_chars.map_lookalikes(clean)
                            if m != clean:
                                keys.append(i), names.append(name), values.append(clean), mapped.append(m)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keys, pa.int64())), *(pa.array(x, pa.string()) for x in (names, values, mapped))], names=[key, "field", "value", "mapped"])

    return src.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, field string, value string, mapped string")


def class_members(df: DataFrame, flagged: DataFrame, key: str = "row_id") -> DataFrame:
    """(class, member, ordinary, n): the spellings of each class with a flagged value and how often each occurs; class is a hash of the collation key."""
    spark = df.sparkSession
    met = spool(spark.sql("SELECT DISTINCT xxhash64(mapped COLLATE UNICODE) AS class FROM {flagged}", flagged=flagged))  # small enough to be sent to the values, or at least without texts
    return spark.sql(
        f"""
        WITH same AS (SELECT xxhash64(v.value COLLATE UNICODE) AS class, v.{key}, v.field, v.value FROM {{values}} v),
             plain AS (SELECT s.class, s.value FROM same s LEFT SEMI JOIN {{met}} met ON s.class = met.class LEFT ANTI JOIN {{flagged}} f ON s.{key} = f.{key} AND s.field = f.field)
        SELECT class, value AS member, true AS ordinary, count(*) AS n FROM plain GROUP BY class, value
        UNION ALL
        SELECT xxhash64(mapped COLLATE UNICODE), mapped, false, count(*) FROM {{flagged}} GROUP BY mapped
        """,
        flagged=flagged,
        met=met,
        values=fields(df, key),
    )


def unify(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, field, value, canonical) of the fields that hold stand-ins."""
    flagged = spool(mapped_fields(df, key))
    return df.sparkSession.sql(
        """
        WITH classes AS (SELECT member COLLATE UNICODE AS form, min_by(member, struct(NOT ordinary, -n, member)) AS canonical FROM {members} GROUP BY member COLLATE UNICODE)
        SELECT f.*, c.canonical
        FROM {flagged} f JOIN classes c ON f.mapped COLLATE UNICODE = c.form
        WHERE f.value <> c.canonical
        """,
        flagged=flagged,
        members=spool(class_members(df, flagged, key)),
    ).drop("mapped")
