"""Small, direct implementations used as independent references."""

import itertools

import numpy as np

STEPS = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def voxel_rows(images):
    """{ms: (phase array, body array or None)} -> rows."""
    out = []
    for ms, (phase, body) in images.items():
        for x, y, z in itertools.product(*map(range, phase.shape)):
            out.append((ms, x, y, z, int(phase[x, y, z]), int(body[x, y, z]) if body is not None else 0))
    return out


def frame(spark, images):
    return spark.createDataFrame(voxel_rows(images), "ms_id string, x int, y int, z int, phase int, body long")


def nodes_edges(mask):
    coords = [tuple(c) for c in np.argwhere(mask)]
    idx = {c: i for i, c in enumerate(coords)}
    edges = []
    for axis, step in enumerate(STEPS):
        for c in coords:
            n = tuple(np.add(c, step))
            if n in idx:
                edges.append((idx[c], idx[n], axis))
    return coords, edges


def solve_grid(mask):
    """Dense half-cell solve: (coords, edges, phi, currents)."""
    coords, edges = nodes_edges(mask)
    n, last = len(coords), mask.shape[0] - 1
    a, b = np.zeros((n, n)), np.zeros(n)
    for u, v, _ in edges:
        a[u, u] += 1
        a[v, v] += 1
        a[u, v] -= 1
        a[v, u] -= 1
    for i, c in enumerate(coords):
        if c[0] == 0:
            a[i, i] += 2
            b[i] += 2
        if c[0] == last:
            a[i, i] += 2
    phi = np.linalg.lstsq(a, b, rcond=None)[0]
    return coords, edges, phi, np.array([phi[u] - phi[v] for u, v, _ in edges])


def flow_edges(mask):
    """Directed edges (up, dn, flow, order) in the order they leave a node."""
    coords, edges, phi, cur = solve_grid(mask)
    last = mask.shape[0] - 1
    src = [(2 * (1 - phi[i]), i) for i, c in enumerate(coords) if c[0] == 0]
    snk = [(2 * phi[i], i) for i, c in enumerate(coords) if c[0] == last]
    top = max([abs(cur).max() if len(cur) else 0] + [abs(f) for f, _ in src] + [1e-14])
    thr = max(1e-14, 1e-10 * top)
    rows = [(u, v, i) for (u, v, _), i in zip(edges, cur) if i > thr]
    rows += [(v, u, -i) for (u, v, _), i in zip(edges, cur) if i < -thr]
    rows += [("S", i, f) for f, i in src if f > thr]
    rows += [(i, "T", f) for f, i in snk if f > thr]
    return coords, phi, rows, thr


def greedy_paths(rows, thr):
    left = [f for _, _, f in rows]
    paths = []
    while True:
        source = max((e for e, r in enumerate(rows) if r[0] == "S"), key=lambda e: (left[e], -e), default=None)
        if source is None or left[source] <= thr:
            return paths
        path, node = [source], rows[source][1]
        while node != "T":
            options = [e for e, r in enumerate(rows) if r[0] == node and left[e] > thr]
            if not options:
                break
            best = max(options, key=lambda e: (left[e], -e))
            path.append(best)
            node = rows[best][1]
        if node != "T":
            left[source] = 0.0
            continue
        amount = min(left[e] for e in path)
        for e in path:
            left[e] = left[e] - amount if left[e] - amount >= thr else 0.0
        paths.append((amount, [rows[e][1] for e in path[:-1]]))


def fifo_paths(rows, phi, thr):
    """Packets in arrival order against edge capacities, high to low potential."""
    left = [f for _, _, f in rows]
    queues, done = {}, []
    for e, (up, dn, f) in enumerate(rows):
        if up == "S":
            queues.setdefault(dn, []).append((f, [dn]))
    for node in np.argsort(-phi, kind="mergesort"):
        for amount, path in queues.get(node, []):
            for e, (up, dn, _) in enumerate(rows):
                if up != node or left[e] <= thr or amount <= thr:
                    continue
                part = min(amount, left[e])
                amount, left[e] = amount - part, left[e] - part
                if dn == "T":
                    done.append((part, path))
                else:
                    queues.setdefault(dn, []).append((part, path + [dn]))
    return done


def neighbours_of(body):
    """Label -> set of touching labels."""
    touch = {int(b): set() for b in np.unique(body) if b > 0}
    for axis in range(3):
        a = np.moveaxis(body, axis, 0)
        for p, q in zip(a[:-1].ravel(), a[1:].ravel()):
            if p > 0 and q > 0 and p != q:
                touch[int(p)].add(int(q))
                touch[int(q)].add(int(p))
    return touch


def face_labels(body):
    return {int(b) for b in np.unique(np.concatenate([body[0].ravel(), body[-1].ravel()])) if b > 0}


def merge_bodies(body):
    """Both merge stages on the label image itself, re-reading it after every merge."""
    body = body.copy()
    while True:
        face, merged = face_labels(body), 0
        todo = sorted(b for b in face if not (neighbours_of(body)[b] - face))
        for b in todo:
            targets = neighbours_of(body)[b] & face
            if targets:
                into = min(targets, key=lambda t: (-(body == t).sum(), t))
                body[body == b] = into
                merged += 1
        if not merged:
            break
    while True:
        face, near = face_labels(body), neighbours_of(body)
        todo = sorted(b for b in near if b not in face and near[b] and near[b] <= face)
        for b in todo:
            body[body == b] = min(near[b], key=lambda t: (-(body == t).sum(), t))
        if not todo:
            return body


def merge_sequentially(size, face, pairs):
    """Both merge stages, label by label: ``(label -> final label, merges of the first stage, of the second)``."""
    size, face, into = dict(size), set(face), {}
    near = {b: set() for b in size}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def merge(gone, target):
        size[target] += size.pop(gone)
        if gone in face:
            face.discard(gone)
            face.add(target)
        for other in near.pop(gone):
            near[other].discard(gone)
            if other != target:
                near[other].add(target)
                near[target].add(other)
        into[gone] = target

    def biggest(labels):
        return min(labels, key=lambda b: (-size[b], b))

    merged = True
    while merged:
        merged = False
        for b in sorted(b for b in face if near[b] <= face):
            if near[b]:
                merge(b, biggest(near[b]))
                merged = True
    n_face = len(into)
    while todo := sorted(b for b in size if b not in face and near[b] and near[b] <= face):
        start = {b: set(near[b]) for b in todo}
        for b in todo:
            merge(b, biggest(start[b]))
    final = {}
    for b in [*size, *into]:
        end = b
        while end in into:
            end = into[end]
        final[b] = end
    return final, n_face, len(into) - n_face
