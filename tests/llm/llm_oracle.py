"""Queries of the subpackage next to their SQL twins: python tests/llm/llm_oracle.py [sf_dir] [name ...]"""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import oracle  # noqa: E402


def check(spark, sf_dir, name):
    from tessera.llm import catalog

    con = oracle.duck(sf_dir)
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    return ("rows only" if sql is None else oracle.compare(got, con.execute(sql).df())), len(got)


if __name__ == "__main__":
    from tessera.llm import catalog
    from tessera.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    session = local_session(8)
    for q in args or catalog.queries():
        t = time.time()
        print(q, *check(session, sf, q), f"{time.time() - t:.1f}s", flush=True)
