"""Compare catalog queries with their SQL: run_compare.py SF_DIR [name ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, connect  # noqa: E402
from srcloom.plans.catalog import CATALOG  # noqa: E402
from srcloom.plans.oracles import ORACLES  # noqa: E402
from srcloom.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(CATALOG)
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                       "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problems = compare(spark, db, CATALOG[name], ORACLES[name], sf_dir)
                result = "equal" if not problems else f"DIFFERS {problems}"
            else:
                result = f"rows {CATALOG[name](spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            result = f"FAILED {type(error).__name__} {str(error)[:900]}"
        print(f"{name} {time.time() - start:.1f}s {result[:1600]}", flush=True)
    missing = [n for n in ORACLES if n not in CATALOG]
    print("oracles without query:", missing)
