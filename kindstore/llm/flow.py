"""Minimum-cost routing of token capacity from membership patterns to source quotas."""

from __future__ import annotations

from collections import deque


def water_fill(sizes: list[int], weights: list[int], ceiling: int) -> list[float]:
    """Shares of the total size by weight, none above ``ceiling`` times its own size.

    What a source can't use is shared again among the others by weight, until none
    is above. Sources are settled in the order in which they reach their ceiling.
    """
    rest, weight = sum(sizes), sum(weights)
    targets = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda s: (ceiling * sizes[s] / weights[s], s))
    for place, s in enumerate(order):
        if rest * weights[s] <= ceiling * sizes[s] * weight:
            for other in order[place:]:
                targets[other] = rest * weights[other] / weight
            break
        targets[s] = float(ceiling * sizes[s])
        rest, weight = rest - ceiling * sizes[s], weight - weights[s]
    return targets


def route(sizes: list[int], members: list[list[int]], quotas: list[int], repeats: int) -> list[dict[int, int]]:
    """The words each pattern sends to each of its sources, at the least cost of repetition.

    Pattern p can send its size once for nothing, once more at cost 1, and so on up
    to ``repeats`` times: convex costs. Costs lie on the edges into patterns alone,
    so shortest paths come in order of the repetition they use, and opening one
    repetition after another, each time pushing all that augmenting paths carry,
    is successive shortest paths. Returns for each pattern its flow by source.
    """
    flows: list[dict[int, int]] = [{} for _ in sizes]
    senders: list[set[int]] = [set() for _ in quotas]  # patterns that send to a source now
    open_quota = list(quotas)
    for _ in range(repeats):
        supply = list(sizes)
        for start, amount in enumerate(supply):
            while amount > 0:
                path = _path(start, members, senders, open_quota)
                if path is None:
                    break
                amount -= _push(path, amount, flows, senders, open_quota)
    return flows


def _path(start: int, members, senders, open_quota) -> list[int] | None:
    """Pattern, source, pattern, ..., source with quota left; later patterns give way at their source."""
    came: dict[int, tuple[int, int] | None] = {start: None}
    seen: set[int] = set()
    line = deque([start])
    while line:
        pattern = line.popleft()
        for source in members[pattern]:
            if source in seen:
                continue
            seen.add(source)
            if open_quota[source] > 0:
                path = [source, pattern]
                while came[pattern] is not None:
                    source, pattern = came[pattern]
                    path += [source, pattern]
                return path[::-1]
            for other in sorted(senders[source]):
                if other not in came:
                    came[other] = (source, pattern)
                    line.append(other)
    return None


def _push(path: list[int], amount: int, flows, senders, open_quota) -> int:
    hops = [(path[i], path[i + 1]) for i in range(0, len(path), 2)]
    back = [(path[i + 2], path[i + 1]) for i in range(0, len(path) - 2, 2)]
    amount = min(amount, open_quota[path[-1]], *(flows[p][s] for p, s in back))
    for p, s in hops:
        flows[p][s] = flows[p].get(s, 0) + amount
        senders[s].add(p)
    for p, s in back:
        flows[p][s] -= amount
        if not flows[p][s]:
            senders[s].discard(p)
    open_quota[path[-1]] -= amount
    return amount
