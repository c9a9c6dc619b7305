"""Print the formatted physical plans of the heavy steps (cube, gold, W8 rank, J11, O1).

usage: python scripts/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lacuna.plans.registry_more import QUERIES  # noqa: E402
from lacuna.session import local_session  # noqa: E402
from lacuna.sources import testdata as TD  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    print("=== order cube (the only job that reads the fact tables) ===")
    TD.order_cube(spark, sf).explain("formatted")
    for name in ("gold_crisis_index", "w1_global_rank", "j11_related_crises", "o1_what_if"):
        print(f"=== {name} ===")
        QUERIES[name][0](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
