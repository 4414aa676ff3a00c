"""Compare all queries with their SQL: python tests/run_oracle.py [sf_dir] [name parts, by comma]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from foldwise.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2].split(",") if len(sys.argv) > 2 else [""]
    spark = local_session(**{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db, sql, failed = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            problems = compare(db, df, sql[name]) if name in sql else []
            note = "ok" if name in sql else f"rows only: {df.count()}"
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
            if parts != [""]:
                traceback.print_exc()
        failed += bool(problems)
        print(f"{name:32s} {time.time() - start:6.2f}s {problems or note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
