"""SQL entry: the engine's functions by name, for use in ``spark.sql``.

They are SQL functions, which Catalyst inlines; none runs in Python except the mean quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.functions import sequence as S

_BASES = "(length({0}) - length(replace({0}, '{1}', '')))"
_GC = f"({_BASES.format('seq', 'G')} + {_BASES.format('seq', 'C')})"
_ACGT = f"({_GC} + {_BASES.format('seq', 'A')} + {_BASES.format('seq', 'T')})"
#: Name, parameters, type and body.
FUNCTIONS = [
    ("hf_gc_content", "seq STRING", "DOUBLE", f"CASE WHEN {_ACGT} = 0 THEN 0D ELSE {_GC} / nullif({_ACGT}, 0) END"),
    ("hf_count_base", "seq STRING, base STRING", "BIGINT", "length(seq) - length(replace(seq, base, ''))"),
    ("hf_complement", "seq STRING", "STRING", f"translate(seq, '{S.COMPLEMENT_FROM}', '{S.COMPLEMENT_TO}')"),
    ("hf_reverse_complement", "seq STRING", "STRING", f"reverse(translate(seq, '{S.COMPLEMENT_FROM}', '{S.COMPLEMENT_TO}'))"),
    ("hf_count_invalid", "seq STRING", "BIGINT", f"length(regexp_replace(seq, '[{S.DNA}]', ''))"),
    ("hf_is_valid_dna", "seq STRING", "BOOLEAN", f"seq RLIKE '^[{S.DNA}]*$'"),
    ("hf_is_valid_rna", "seq STRING", "BOOLEAN", f"seq RLIKE '^[{S.RNA}]*$'"),
    ("hf_meets_length", "seq STRING, least BIGINT, most BIGINT", "BOOLEAN", "length(seq) BETWEEN least AND most"),
    ("hf_region", "seq STRING, start INT, stop INT", "STRING", "substr(seq, start + 1, stop - start)"),
]


def register(spark: SparkSession, views: dict[str, DataFrame] | None = None) -> None:
    """Make the functions, and ``views`` by their names, known to the session; what is known already is replaced."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("hf_mean_quality", S.mean_quality_udf)
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
