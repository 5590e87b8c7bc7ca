"""Print the formatted physical plan of catalogue queries.

    python tools/explain.py <sf_dir> <query> [<query> ...]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main():
    sf, names = sys.argv[1], sys.argv[2:]
    from tastemap.session import local_session
    from tastemap.plans.catalogue import QUERIES
    spark = local_session(8, 16)
    for n in names:
        print(f"===== {n}")
        QUERIES[n](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
