"""The line functions as Spark SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """``log_format``, ``log_signature``, ``log_normalized``, ``log_level_of_priority`` and others, as SQL-defined functions.

    They are plain SQL expressions, which the optimizer sees through.
    """
    az, AZ = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    level = "case when translate(v, '{A}', '{a}') in ('trace','debug','info','warn','error','fatal','panic') then initcap(translate(v, '{A}', '{a}')) end".format(A=AZ, a=az)
    defined = {
        "log_format(raw string)": "string return case when startswith(raw, '{') then 'json' when startswith(raw, '[') then 'plain_bracketed' when raw rlike '(?:^|[ \\\\t])(?:level|severity|lvl)=' then 'plain_logfmt' else 'plain_unknown' end",
        "log_level_named(v string)": f"string return {level}",
        "log_signature(raw string)": f"string return translate(regexp_replace(regexp_replace(raw, '[a-fA-F][0-9a-fA-F]{{7,}}', '<id>'), '[0-9]+', '#'), '{AZ}', '{az}')",
        "log_normalized(raw string)": f"string return trim(regexp_replace(translate(regexp_replace(regexp_replace(raw, '(?:\\\\G|(?<![0-9]))[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', '<date>'), '[0-9]+', '#'), '{AZ}', '{az}'), '[ \\\\t\\\\n\\\\r\\\\x0B\\\\f]+', ' '))",
    }
    for head, body in defined.items():
        spark.sql(f"create or replace temporary function {head} returns {body}")
