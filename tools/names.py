"""Names of the queries a plans module registers: python tools/names.py MODULE ..."""

import importlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from fieldnote.plans import registry  # noqa: E402

for module in sys.argv[1:]:
    before = set(registry.QUERIES)
    importlib.import_module(f"fieldnote.plans.{module}")
    print(*[n for n in registry.QUERIES if n not in before])
