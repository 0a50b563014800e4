"""The edge store one operation at a time, in plain Python: what the DataFrame operators must equal."""

ORD = {0: 0, 3: 1, 2: 2, 1: 3}
STATE = {1: 0, 2: 1, 3: 2, 4: 3}


def write(edges, key, t, state, pos):
    """One edge operation by the truth table; edges: key -> [position, time, state]."""
    old = edges.get(key)
    if old is None:
        edges[key] = [pos, t, state]
        return
    if (t, ORD[state]) < (old[1], ORD[old[2]]):
        return
    if old[2] in (1, 3) and state == 0:
        old[0] = pos
    old[1], old[2] = t, state


def serial(ops):
    """ops: (seq, graph, source, forward, ids or None, op, position, time) -> edges, node states."""
    edges, nodes = {}, {}

    def dominant(key, state):
        g, s, d = key
        return max([state, nodes.get((g, 0, s), (0, 0))[1], nodes.get((g, 1, d), (0, 0))[1]], key=ORD.get)

    seen = set()
    for seq, g, s, fwd, ids, op, pos, t in sorted(ops, key=lambda o: o[0]):
        if seq in seen:
            continue
        seen.add(seq)
        state = STATE[op]
        if ids is None:
            n = (g, 0 if fwd else 1, s)
            if n not in nodes or (t, ORD[state]) >= (nodes[n][0], ORD[nodes[n][1]]):
                nodes[n] = (t, state)
            for key in [k for k in edges if k[0] == g and k[1 if fwd else 2] == s]:
                if edges[key][2] != 1:
                    write(edges, key, t, dominant(key, state), t * 1000 << 20)
        else:
            for other in ids:
                key = (g, s, other) if fwd else (g, other, s)
                write(edges, key, t, dominant(key, state), pos)
    return edges, nodes
