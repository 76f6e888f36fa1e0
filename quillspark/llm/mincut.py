"""Minimum cut of a small graph with a source and a sink, by maximum flow."""

from __future__ import annotations

from collections import deque


def min_cut(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    `terminal`: how much more a node costs on the sink's side than on the source's; `edges`: (node, node, cost of parting them), both
    ways. A node whose own cost is not less than that of all its edges is on its side in some minimum cut, so it is placed at once and
    its edges become costs of its neighbours; what is left goes to maximum flow. Of equal cuts, one with few nodes at the source."""
    n = len(terminal)
    cost, near = list(terminal), [{} for _ in range(n)]
    for u, v, c in edges:
        if u != v and c > 0:
            near[u][v] = near[u].get(v, 0) + c
            near[v][u] = near[v].get(u, 0) + c
    total = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        v = queue.popleft()
        if side[v] is not None or abs(cost[v]) < total[v]:
            continue
        side[v] = cost[v] > 0
        for u, c in near[v].items():
            del near[u][v]
            total[u] -= c
            cost[u] += c if side[v] else -c
            queue.append(u)
        near[v] = {}
    left = [v for v in range(n) if side[v] is None]
    if left:
        number = {v: i for i, v in enumerate(left)}
        reached = _source_side([cost[v] for v in left], [(number[v], number[u], c) for v in left for u, c in near[v].items() if u > v])
        for v in left:
            side[v] = reached[number[v]]
    return [bool(s) for s in side]


def _source_side(cost: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes that the source still reaches once the flow is greatest (levels and blocking flows)."""
    n = len(cost)
    source, sink = n, n + 1
    out: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[int] = []

    def arc(u: int, v: int, there: int, back: int) -> None:
        out[u].append(len(head))
        head.append(v)
        room.append(there)
        out[v].append(len(head))
        head.append(u)
        room.append(back)

    for v, c in enumerate(cost):
        if c > 0:
            arc(source, v, c, 0)
        elif c < 0:
            arc(v, sink, -c, 0)
    for u, v, c in edges:
        arc(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [level[v] >= 0 for v in range(n)]
        turn, path, u = [0] * (n + 2), [], source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(i for i, e in enumerate(path) if not room[e])
                u = head[path[full] ^ 1]
                del path[full:]
                continue
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if room[e] and level[head[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(out[u][turn[u]])
                u = head[out[u][turn[u]]]
            elif path:
                e = path.pop()
                u = head[e ^ 1]
                turn[u] += 1
            else:
                break
