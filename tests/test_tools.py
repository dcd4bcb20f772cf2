import pytest

from marginalia.operators.tools import Tools


def test_permissions_depth_and_budget():
    now = [0.0]
    tools = Tools(clock=lambda: now[0])
    tools.add("count", lambda: 3)
    tools.add("ask", lambda: tools.call("a", "count"))
    tools.add("deep", lambda: tools.call("a", "ask"))
    tools.permit("a", ["count", "ask", "deep"])
    tools.permit("b", ["count"])
    assert tools.call("b", "count") == 3 and tools.call("a", "ask") == 3
    with pytest.raises(PermissionError):
        tools.call("b", "ask")
    with pytest.raises(PermissionError):
        tools.call("nobody", "count")
    with pytest.raises(RecursionError):
        tools.call("a", "deep")
    tools.add("slow", lambda: (now.__setitem__(0, now[0] + 9), tools.call("a", "count")))
    tools.permit("a", ["count", "slow"])
    with pytest.raises(TimeoutError):
        tools.call("a", "slow")
    assert tools.call("a", "count") == 3
    with pytest.raises(ValueError):
        tools.add("count", len)
    with pytest.raises(KeyError):
        tools.permit("a", ["none"])
