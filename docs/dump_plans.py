"""Write the formatted physical plans of key queries to docs/plans/.

    python docs/dump_plans.py [/root/testdata/sf0.1]
"""

import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEYS = ["category_performance", "segment_performance", "monthly_features",
        "category_features", "dash_segment_aov", "category_hierarchy", "ship_lag_profile",
        "one_hot_counts", "future_features"]


def main(sf_dir: str) -> None:
    from kpiforge.plans.registry import QUERIES
    from kpiforge.session import local_session
    spark = local_session(8)
    out = os.path.join(os.path.dirname(os.path.abspath(__file__)), "plans")
    for k in KEYS:
        df = QUERIES[k](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()   # final adaptive plan
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        with open(os.path.join(out, f"{k}.txt"), "w") as fh:
            fh.write(buf.getvalue())


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
