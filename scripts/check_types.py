"""Compare column types of every query (Spark schema) with its SQL (DuckDB DESCRIBE)."""

from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def main():
    from repsight.plans import ORACLE, QUERIES
    from repsight.session import local_session

    base = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or sorted(QUERIES)
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
    bad = 0
    for name in names:
        sch = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in QUERIES[name](spark, base).schema.fields}
        duck = {r[0]: r[1] for r in con.sql(f"DESCRIBE {ORACLE[name]}").fetchall()}
        diff = {k: (sch.get(k), duck.get(k)) for k in set(sch) | set(duck) if sch.get(k) != duck.get(k)}
        if diff:
            bad += 1
            print(f"{name:26s} {diff}")
    print("type mismatches:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
