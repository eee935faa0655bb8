"""A minimum cut between two terminals over a small sparse graph."""

from __future__ import annotations

from collections import deque

_EPS = 1e-9


def split(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the cost: True costs ``max(0, -u)``, False ``max(0, u)``, an edge its weight if its ends differ.

    A node whose own cost is at least the sum of its edges keeps its own label in some minimum, so it is
    fixed and its edges become costs of its neighbours; the rest is a maximum flow by level graphs.
    """
    n = len(unary)
    cost = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(cost[i]) >= sum(near[i].values()):
            label[i] = cost[i] > 0
            for j, w in near[i].items():
                cost[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        s, t = len(rest), len(rest) + 1
        flow: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
        for i in rest:
            k = place[i]
            for j, w in near[i].items():
                flow[k][place[j]] = w
            if cost[i] > 0:
                flow[s][k], flow[k][s] = cost[i], 0.0
            elif cost[i] < 0:
                flow[k][t], flow[t][k] = -cost[i], 0.0
        level = _levels(flow, s)
        while level[t] >= 0:
            at = [list(f) for f in flow]
            while _push(flow, level, at, s, t):
                pass
            level = _levels(flow, s)
        for i in rest:
            label[i] = level[place[i]] >= 0
    return [bool(x) for x in label]


def _levels(flow: list[dict[int, float]], s: int) -> list[int]:
    level = [-1] * len(flow)
    level[s] = 0
    queue = deque([s])
    while queue:
        i = queue.popleft()
        for j, c in flow[i].items():
            if c > _EPS and level[j] < 0:
                level[j] = level[i] + 1
                queue.append(j)
    return level


def _push(flow: list[dict[int, float]], level: list[int], at: list[list[int]], s: int, t: int) -> bool:
    """One path of the level graph, found by depth, and the flow it takes."""
    path = [s]
    while path[-1] != t:
        i = path[-1]
        while at[i] and not (flow[i][at[i][-1]] > _EPS and level[at[i][-1]] == level[i] + 1):
            at[i].pop()
        if at[i]:
            path.append(at[i][-1])
        else:
            path.pop()
            if not path:
                return False
            at[path[-1]].pop()
    amount = min(flow[a][b] for a, b in zip(path, path[1:], strict=False))
    for a, b in zip(path, path[1:], strict=False):
        flow[a][b] -= amount
        flow[b][a] = flow[b].get(a, 0.0) + amount
    return True
