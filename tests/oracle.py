"""Compare registered queries with their SQL on the same parquet tables."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item") and not isinstance(v, (list, dict)):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)) if x is not None else "", str(x)) for x in row)


def _close(a, b, tol: float) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark_df, con, sql: str, show: int = 4, tol: float = 0.0) -> list[str]:
    """Differences between the two results, empty when equal.

    ``tol`` forgives a last digit: a value halfway between two roundings may go either way.
    """
    rel = con.sql(sql)
    names = [d[0] for d in rel.description]
    issues = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    order = sorted(names)
    got = [tuple(_norm(r[c]) for c in order) for r in spark_df.collect()]
    idx = [names.index(c) for c in order]
    want = [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]
    if len(got) != len(want):
        issues.append(f"rows {len(got)} != {len(want)}")
    kinds_g = {c: {type(r[i]).__name__ for r in got if r[i] is not None} for i, c in enumerate(order)}
    kinds_w = {c: {type(r[i]).__name__ for r in want if r[i] is not None} for i, c in enumerate(order)}
    for c in order:
        if kinds_g[c] != kinds_w[c] and kinds_g[c] and kinds_w[c]:
            issues.append(f"type {c}: {kinds_g[c]} != {kinds_w[c]}")
    exact = [i for i, c in enumerate(order) if "float" not in kinds_g[c] | kinds_w[c]]

    def by_keys(row):
        return _key([row[i] for i in exact]), _key(row)

    g, w = sorted(got, key=by_keys), sorted(want, key=by_keys)
    bad = [(a, b) for a, b in zip(g, w) if not all(_close(x, y, tol) for x, y in zip(a, b))]
    if bad:
        issues.append(f"{len(bad)} of {len(w)} rows differ")
        only_g, only_w = sorted(set(g) - set(w), key=_key), sorted(set(w) - set(g), key=_key)
        for a, b in list(zip(only_g, only_w))[:show]:
            issues.append("  " + " | ".join(f"{c}: {x!r} vs {y!r}" for c, x, y in zip(order, a, b) if x != y)[:400])
        if not list(zip(only_g, only_w)):
            issues.append(f"  only here {only_g[:2]} only sql {only_w[:2]}")
    return issues


def main(folder: str, wanted: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from alphaloom.session import local_session

    spark = local_session("8")
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                issues = compare(df, con, sqls[name])
                tag = "ok"
            else:
                issues, tag = ([] if df.count() > 0 else ["no rows"]), "ok (rows only)"
        except Exception as e:  # report and go on
            issues, tag = [f"{type(e).__name__}: {str(e)[:600]}"], ""
        took = time.time() - t0
        if issues:
            failed += 1
            print(f"FAIL {name} {took:.1f}s")
            for i in issues:
                print("    ", i)
        else:
            print(f"{tag} {name} {took:.1f}s")
        sys.stdout.flush()
    print(f"{failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
