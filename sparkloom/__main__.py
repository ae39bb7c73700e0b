"""python -m sparkloom list | run NAME [key=value ...] | count NAME ... | save NAME path=URI ... | verify URI"""

from __future__ import annotations

import sys

from .plans import bundled, pipelines
from .session import session
from .sources import verify


def main(args: list[str]) -> int:
    what, *rest = args or ["help"]
    if what == "list":
        print("\n".join(pipelines.names()))
        return 0
    if what not in ("run", "count", "save", "verify") or not rest:
        print(__doc__)
        return 2
    spark = session("sparkloom-cli")
    try:
        if what == "verify":
            print(f"{len(verify(spark, rest[0])['partitions'])} files verified")
            return 0
        name, *pairs = rest
        params = dict(p.split("=", 1) for p in pairs)
        got = pipelines.run(spark, name, {"run": "collect"}.get(what, what), **params)
        for row in got if what == "run" else [got]:
            print(row)
        return 0
    finally:
        spark.stop()


assert bundled  # registers its pipelines

if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
