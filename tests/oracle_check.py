"""Compare the registered queries with their oracle SQL: python tests/oracle_check.py SF_DIR [NAME...]"""

import datetime
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0 if math.isfinite(x) else str(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, sf_dir, names=None):
    """{name: None if equal, else what differs} of the queries with an oracle."""
    import __spark_entry__ as entry

    queries, out = entry.queries(), {}
    for name, sql in entry.oracle_sql().items():
        if names and name not in names:
            continue
        try:
            got = queries[name](spark, sf_dir)
            with duckdb.connect() as con:
                for file in os.listdir(sf_dir):
                    con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
                cur = con.execute(sql)
                want_columns, want = [x[0] for x in cur.description], cur.fetchall()
            have = rows(got.columns, [tuple(r) for r in got.collect()])
            if sorted(got.columns) != sorted(want_columns):
                out[name] = f"columns {sorted(got.columns)} and {sorted(want_columns)}"
            elif have != (want := rows(want_columns, want)):
                odd = [(a, b) for a, b in zip(have, want, strict=False) if a != b][:2]
                out[name] = f"{len(have)} and {len(want)} rows, e.g. {odd}"
            else:
                out[name] = None
        except Exception as e:  # noqa: BLE001
            out[name] = f"{type(e).__name__}: {str(e)[:400]}"
    return out


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    found = differences(spark, sys.argv[1], sys.argv[2:])
    for name, what in found.items():
        if what:
            print(name, "DIFFERS", what[:700])
    print(sum(not x for x in found.values()), "of", len(found), "equal")
