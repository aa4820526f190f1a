from __future__ import annotations

import pytest

pytest.importorskip("glyphmine.llm")

#: Columns whose names the operators might use themselves.
CLASH = "'x' as host, 1 as line, 2 as n, 3 as id, 4 as i, 't' as t, 5 as k, 6 as group_id, 7 as near_dropped_id, 8 as mix_id, 9 as copies, true as kept, 'y' as key"


@pytest.fixture(scope="session")
def clash():
    return CLASH.split(", ")
