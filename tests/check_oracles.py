"""Run registered queries beside their SQL: ``python tests/check_oracles.py [dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str | None:
    """Difference between both results, or ``None``."""
    table = con.execute(sql).to_arrow_table()
    ours = df.toArrow()
    if sorted(ours.column_names) != sorted(table.column_names):
        return f"columns {ours.column_names} against {table.column_names}"
    kinds = {n: (str(ours.schema.field(n).type), str(table.schema.field(n).type)) for n in table.column_names}
    odd = {n: k for n, k in kinds.items() if k[0].replace("large_", "") != k[1].replace("large_", "")}
    if odd:
        return f"types {odd}"
    left = normal(zip(*[c.to_pylist() for c in ours.columns]), ours.column_names)
    right = normal(zip(*[c.to_pylist() for c in table.columns]), table.column_names)
    if left != right:
        pairs = [(a, b) for a, b in zip(left, right) if a != b][:2]
        return f"{len(left)} rows against {len(right)}; {pairs}"
    return None


if __name__ == "__main__":
    from conftest import make_session

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(sf_dir)
    wrong = 0
    for name, run in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            made = run(spark, sf_dir)
            sql = oracle_sql().get(name)
            difference = compare(made, con, sql) if sql else f"{made.count()} rows, no SQL" and None
        except Exception as error:
            difference = f"{type(error).__name__}: {str(error)[:600]}"
        wrong += difference is not None
        print(f"{'ok ' if difference is None else 'BAD'} {name} {time.time() - start:.2f}s {difference or ''}")
    print(f"{wrong} differ")
    sys.exit(wrong > 0)
