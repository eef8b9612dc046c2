"""Sequential and dense algorithms: one group a scene, on rows reduced beforehand."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ["x", "y", "z"]


def farthest_points(points: DataFrame, n: int, by: str = "scene_id", key: str = "point_id") -> DataFrame:
    """Farthest point sampling from the first point on: (scene, rank, key); ties go to the earlier point."""

    def run(scene: pd.DataFrame) -> pd.DataFrame:
        scene = scene.sort_values(key, ignore_index=True)
        xyz = scene[AXES].to_numpy(float)
        gap, picked = np.full(len(xyz), np.inf), [0]
        while len(picked) < min(n, len(xyz)):
            gap = np.minimum(gap, ((xyz - xyz[picked[-1]]) ** 2).sum(axis=1))
            picked.append(int(gap.argmax()))
        return pd.DataFrame({by: scene[by].iloc[0], "rank": np.arange(len(picked)), key: scene[key].to_numpy()[picked]})

    return points.select(by, key, *AXES).groupBy(by).applyInPandas(run, f"{by} long, rank long, {key} long")


def patches(points: DataFrame, share: int, k: int, cell: float, by: str = "scene_id", key: str = "point_id") -> DataFrame:
    """Anchors by farthest points (each scene's own count / share, one at least) with their k nearest points."""
    from .spatial import knn

    wanted = points.groupBy(by).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / share)).alias("_wanted"))
    most = wanted.agg(F.max("_wanted")).first()[0] or 1
    ranked = farthest_points(points, int(most), by, key).join(wanted, by).where("rank < _wanted")  # any first part of the order is itself one
    anchors = ranked.select(by, key).join(points.select(by, key, *AXES), [by, key]).withColumnRenamed(key, "q")
    return knn(anchors, points.select(by, F.col(key).alias("n"), *AXES), k, cell, by)


def estimate_normals(points: DataFrame, neighbours: DataFrame, radius: float, by: str = "scene_id", key: str = "point_id") -> DataFrame:
    """Normal of each point: the direction of least spread of its neighbours within ``radius``.

    Moments are sums over the neighbour join; only the 3x3 eigenproblem runs in Arrow batches.
    """
    near = neighbours.where(F.col("d2") <= radius * radius).join(points.select(by, F.col(key).alias("n"), *AXES), [by, "n"])
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    sums = near.groupBy(by, F.col("q").alias(key)).agg(F.count(F.lit(1)).alias("m"), *(F.avg(a).alias(a) for a in AXES), *(F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs))

    def run(batches):
        for lot in batches:
            c = np.empty((len(lot), 3, 3))
            for i, a in enumerate(AXES):
                for j, b in enumerate(AXES):
                    c[:, i, j] = lot[min(a, b) + max(a, b)] - lot[a] * lot[b]
            v = np.linalg.eigh(c)[1][:, :, 0]
            lead = v[np.arange(len(v)), np.abs(v).argmax(axis=1)]
            v *= np.where(lead < 0, -1, 1)[:, None]
            yield pd.DataFrame({by: lot[by], key: lot[key], "nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2], "m": lot["m"]})

    return sums.mapInPandas(run, f"{by} long, {key} long, nx double, ny double, nz double, m long")


def floor_plane(points: DataFrame, below: float = 0.25, within: float = 0.05, tries: int = 1000, seed: int = 0, by: str = "scene_id") -> DataFrame:
    """Plane a x + b y + c z = d of a scene's low points that most of them lie on, by seeded random triples."""

    def run(scene: pd.DataFrame) -> pd.DataFrame:
        xyz = scene.sort_values(AXES)[AXES].to_numpy(float)
        rng, best = np.random.default_rng(seed), (-1, np.zeros(3), 0.0)
        for _ in range(tries if len(xyz) >= 3 else 0):
            a, b, c = xyz[rng.choice(len(xyz), 3, replace=False)]
            normal = np.cross(b - a, c - a)
            size = np.linalg.norm(normal)
            if size < 1e-12:
                continue
            normal = normal / size * (1 if normal[2] >= 0 else -1)
            hits = int((np.abs((xyz - a) @ normal) <= within).sum())
            if hits > best[0]:
                best = hits, normal, float(normal @ a)
        return pd.DataFrame({by: [scene[by].iloc[0]], "a": [best[1][0]], "b": [best[1][1]], "c": [best[1][2]], "d": [best[2]], "inliers": [max(0, best[0])]})

    return points.where(F.col("z") < below).select(by, *AXES).groupBy(by).applyInPandas(run, f"{by} long, a double, b double, c double, d double, inliers long")


def density_tree_clusters(points: DataFrame, least: int, near: int = 5, by: str = "scene_id", key: str = "point_id") -> DataFrame:
    """Hierarchical density clustering: (scene, key, cluster), -1 for noise.

    Mutual reachability distances span a least tree; cutting it from the
    longest edge down gives a hierarchy in which parts below ``least`` points
    fall out; the selected clusters are the most stable ones.
    """

    def run(scene: pd.DataFrame) -> pd.DataFrame:
        scene = scene.sort_values(key, ignore_index=True)
        label = _stable_clusters(scene[AXES].to_numpy(float), least, near)
        return pd.DataFrame({by: scene[by].iloc[0], key: scene[key], "cluster": label})

    return points.select(by, key, *AXES).groupBy(by).applyInPandas(run, f"{by} long, {key} long, cluster long")


def _stable_clusters(xyz: np.ndarray, least: int, near: int) -> np.ndarray:
    n = len(xyz)
    label = np.full(n, -1)
    if n < 2:
        return label
    core = np.empty(n)
    for i in range(n):
        d = np.sqrt(((xyz - xyz[i]) ** 2).sum(axis=1))
        core[i] = np.partition(d, min(near, n - 1))[min(near, n - 1)]
    edges, reach, link, out = [], np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        out[at] = False
        d = np.maximum(np.maximum(np.sqrt(((xyz - xyz[at]) ** 2).sum(axis=1)), core), core[at])
        closer = out & (d < reach)
        reach[closer], link[closer] = d[closer], at
        at = int(np.where(out, reach, np.inf).argmin())
        edges.append((reach[at], link[at], at))
    edges.sort()
    parent, node, size, kids, height = list(range(n)), list(range(n)), [1] * n, {}, {}

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for d, a, b in edges:
        a, b = root(a), root(b)
        new = len(size)
        kids[new], height[new] = (node[a], node[b]), d
        size.append(size[node[a]] + size[node[b]])
        parent[b], node[a] = a, new
    top = len(size) - 1
    stability, tree, members = {}, {}, {}
    todo = [(top, top, 0.0)]
    while todo:
        at, own, born = todo.pop()
        stability.setdefault(own, 0.0), tree.setdefault(own, []), members.setdefault(own, at)
        while at in kids:
            lam = 1 / max(height[at], 1e-12)
            big = [k for k in kids[at] if size[k] >= least]
            if len(big) == 2:
                stability[own] += size[at] * (lam - born)
                tree[own] = big
                todo += [(k, k, lam) for k in big]
                break
            stability[own] += sum(size[k] for k in kids[at] if size[k] < least) * (lam - born)
            if not big:
                break
            at = big[0]
    best, chosen = {}, {}
    for c in sorted(tree, key=lambda c: size[c]):
        below = sum(best[k] for k in tree[c])
        whole = c != top and stability[c] >= below
        best[c] = stability[c] if whole or not tree[c] and c != top else below
        chosen[c] = [c] if whole or not tree[c] and c != top else [x for k in tree[c] for x in chosen[k]]
    for i, c in enumerate(sorted(chosen[top])):
        todo = [c]
        while todo:
            v = todo.pop()
            if v in kids:
                todo += kids[v]
            else:
                label[v] = i
    return label


def graph_cut(nodes: DataFrame, edges: DataFrame, by: str = "scene_id") -> DataFrame:
    """Least s-t cut of each scene: (scene, node, source_side).

    ``nodes``: node, to_source and to_sink capacities; ``edges``: src, dst and
    capacity in both directions. Shortest augmenting paths in levels.
    """
    packed = edges.groupBy(by).agg(F.collect_list(F.struct("src", "dst", "capacity")).alias("edges"))
    rows = nodes.groupBy(by).agg(F.collect_list(F.struct("node", "to_source", "to_sink")).alias("nodes")).join(packed, by, "left")

    def run(batches):
        for lot in batches:
            for scene, ns, es in zip(lot[by], lot["nodes"], lot["edges"]):
                names = sorted(n["node"] for n in ns)
                at = {v: i for i, v in enumerate(names)}
                s, t = len(names), len(names) + 1
                arcs = [(s, at[n["node"]], n["to_source"]) for n in ns] + [(at[n["node"]], t, n["to_sink"]) for n in ns]
                arcs += [(at[e["src"]], at[e["dst"]], e["capacity"]) for e in (es if es is not None else [])]
                side = _min_cut(len(names) + 2, arcs, s, t)
                yield pd.DataFrame({by: scene, "node": names, "source_side": side[: len(names)]})

    return rows.mapInPandas(run, f"{by} long, node long, source_side boolean")


def _min_cut(n: int, arcs: list[tuple[int, int, float]], s: int, t: int) -> list[bool]:
    head, room, out = [], [], [[] for _ in range(n)]
    for a, b, c in arcs:
        out[a].append(len(head))
        head.append(b), room.append(float(c))
        out[b].append(len(head))
        head.append(a), room.append(0.0)

    def levels():
        depth, todo = [-1] * n, deque([s])
        depth[s] = 0
        while todo:
            v = todo.popleft()
            for e in out[v]:
                if room[e] > 1e-12 and depth[head[e]] < 0:
                    depth[head[e]] = depth[v] + 1
                    todo.append(head[e])
        return depth

    while (depth := levels())[t] >= 0:
        tried, path, v = [0] * n, [], s
        while True:
            if v == t:
                most = min(room[e] for e in path)
                for e in path:
                    room[e] -= most
                    room[e ^ 1] += most
                path, v = [], s
                continue
            while tried[v] < len(out[v]):
                e = out[v][tried[v]]
                if room[e] > 1e-12 and depth[head[e]] == depth[v] + 1:
                    break
                tried[v] += 1
            if tried[v] < len(out[v]):
                path.append(out[v][tried[v]])
                v = head[path[-1]]
            elif v == s:
                break
            else:
                v = head[path.pop() ^ 1]
                tried[v] += 1
    return [d >= 0 for d in depth]


def random_cuboid(points: DataFrame, side: float, least: int, tries: int = 100, seed: int = 0, by: str = "scene_id", key: str = "point_id") -> DataFrame:
    """Points of a random box of reach ``side`` times the scene's with at least ``least`` points; all of them after ``tries``."""

    def run(scene: pd.DataFrame) -> pd.DataFrame:
        scene = scene.sort_values(key, ignore_index=True)
        xyz, rng = scene[AXES].to_numpy(float), np.random.default_rng(seed)
        reach = np.ptp(xyz, axis=0) * side / 2
        for _ in range(tries):
            inside = (np.abs(xyz - xyz[rng.integers(len(xyz))]) <= reach).all(axis=1)
            if inside.sum() >= least:
                return scene.loc[inside, [by, key]]
        return scene[[by, key]]

    return points.select(by, key, *AXES).groupBy(by).applyInPandas(run, f"{by} long, {key} long")


def blur_scores(images: DataFrame, size: int = 60, key: str = "image_id") -> DataFrame:
    """Mean log magnitude of what is left of a grey image without its low frequencies; ``images``: key, rows, cols, grey."""

    def run(batches):
        for lot in batches:
            out = []
            for r, c, grey in zip(lot["rows"], lot["cols"], lot["grey"]):
                f = np.fft.fftshift(np.fft.fft2(np.reshape(grey, (r, c))))
                cy, cx = r // 2, c // 2
                f[max(0, cy - size) : cy + size, max(0, cx - size) : cx + size] = 0
                out.append(float((20 * np.log(np.abs(np.fft.ifft2(np.fft.ifftshift(f))) + 1e-12)).mean()))
            yield pd.DataFrame({key: lot[key], "score": out})

    return images.mapInPandas(run, f"{key} long, score double")
