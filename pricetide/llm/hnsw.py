"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, shard results merged."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm import vectors
from pricetide.session import stage

SHARD_ROWS = 16_384  # distinct vectors per graph
QUERY_BLOCK = 16_384  # distinct query vectors that meet a shard together; the index is shuffled once for each block
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 64, 192
TOGETHER = 256  # nodes added, or queries walked, at a time
STEP = 6  # nodes opened per walk and round
SEED = 7


class Layers:
    """The graph of one shard: per layer a flat array of neighbour numbers, -1 where a list ends.

    Nodes are numbered by falling level, so layer l holds the nodes 0 .. sizes[l] - 1. Row i of a layer's array, of
    width 2 * LINKS on layer 0 and LINKS above, lists the neighbours of node i.
    """

    def __init__(self, unit: np.ndarray, sizes: list[int], links: int = LINKS, neighbours: list[np.ndarray] | None = None):
        self.unit, self.sizes, self.links = unit, sizes, links
        self.neighbours = neighbours or [np.full((n, links * (1 if layer else 2)), -1, np.int32) for layer, n in enumerate(sizes)]

    def walk(self, layer: int, queries: np.ndarray, entry: np.ndarray, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walks of all queries at once: the ``width`` nearest nodes found below number ``limit``, nearest first.

        ``entry`` holds start nodes per query. Returns node numbers (-1: none) and similarities.
        """
        seen = np.zeros((len(queries), limit + 1), bool)  # the last column takes what is no node
        seen[:, limit] = True
        beam = np.full((len(queries), width), -1, np.int32)
        near = np.full((len(queries), width), -np.inf, np.float32)
        opened = np.ones((len(queries), width), bool)
        fresh = np.where((entry < 0) | (entry >= limit), 0, entry).astype(np.int32)  # node 0 for starts not in the layer yet
        active, lists = np.arange(len(queries)), self.neighbours[layer]
        while True:
            row = active[:, None]
            fresh.sort(axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = limit
            fresh[seen[row, fresh]] = limit
            seen[row, fresh] = True
            most = max(1, int((fresh < limit).sum(axis=1).max()))
            if most < fresh.shape[1]:  # no columns without a new node
                fresh = np.sort(fresh, axis=1)[:, :most]
            void = fresh == limit
            found = np.matmul(self.unit[np.minimum(fresh, limit - 1)], queries[active][:, :, None])[:, :, 0]
            found[void] = -np.inf
            all_near = np.concatenate([near[active], found], axis=1)
            top = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            here = np.arange(len(active))[:, None]
            kept = all_near[here, top]
            near[active] = kept
            beam[active] = np.concatenate([beam[active], np.where(void, -1, fresh)], axis=1)[here, top]
            done = np.concatenate([opened[active], void], axis=1)[here, top]
            pick = np.argpartition(np.where(done, np.inf, -kept), STEP - 1, axis=1)[:, :STEP] if width > STEP else np.arange(width)[None, :].repeat(len(active), 0)
            valid = ~done[here, pick]
            done[here, pick] = True
            opened[active] = done
            going = valid.any(axis=1)
            if not going.any():
                break
            active = active[going]
            nodes = np.where(valid[going], beam[active[:, None], pick[going]], -1)
            fresh = np.where(nodes[:, :, None] >= 0, lists[nodes], -1).reshape(len(active), -1)
            fresh[(fresh < 0) | (fresh >= limit)] = limit
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(beam, order, 1).astype(np.int64), np.take_along_axis(near, order, 1)

    def choose(self, base: np.ndarray, candidates: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Per node the neighbours to link: nearest first, left out where a chosen one is nearer to the candidate than
        the node is; free places go to the nearest left out."""
        order = np.argsort(-near, axis=1, kind="stable")
        candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
        valid = candidates >= 0
        points = self.unit[np.maximum(candidates, 0)]
        between = points @ points.transpose(0, 2, 1)
        chosen = np.zeros(candidates.shape, bool)
        count = np.zeros(len(base), int)
        for c in range(candidates.shape[1]):
            rival = np.where(chosen, between[:, c, :], -np.inf).max(axis=1)
            chosen[:, c] = valid[:, c] & (count < most) & (rival < near[:, c])
            count += chosen[:, c]
        rank = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(candidates, rank, 1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out

    def link(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        lists = self.neighbours[layer]
        lists[new, : chosen.shape[1]] = chosen
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, number = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(nodes), TOGETHER):
            part, start, n = nodes[at : at + TOGETHER], first[at : at + TOGETHER], number[at : at + TOGETHER]
            extra = np.full((len(part), n.max()), -1, np.int64)
            column = np.arange(n.max())[None, :]
            has = column < n[:, None]
            extra[has] = source[(start[:, None] + column)[has]]
            old = lists[part].astype(np.int64)
            extra[(extra[:, :, None] == old[:, None, :]).any(axis=2)] = -1
            merged = np.concatenate([old, extra], axis=1)
            merged = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), 1)
            full = (merged >= 0).sum(axis=1) > lists.shape[1]
            lists[part[~full]] = merged[~full][:, : lists.shape[1]]
            if full.any():
                over = merged[full]
                near = np.einsum("qnd,qd->qn", self.unit[np.maximum(over, 0)], self.unit[part[full]])
                near[over < 0] = -np.inf
                lists[part[full]] = self.choose(part[full], over, near, lists.shape[1])

    def enter(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """Start nodes of layer ``down_to``, from walks through the layers above."""
        entry = np.zeros((len(queries), 1), np.int64)
        for layer in range(len(self.sizes) - 1, down_to, -1):
            entry = self.walk(layer, queries, entry, STEP, self.sizes[layer])[0]
        return entry

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self.walk(0, queries, self.enter(queries, 0), width, self.sizes[0])


def build(unit: np.ndarray, seed: int = SEED, links: int = LINKS, width: int = BUILD_WIDTH) -> tuple[Layers, np.ndarray]:
    """The graph over unit vectors and the order its numbers refer to. Layers are filled from the top; nodes are added in
    groups that at most double the layer, each linked to what a walk finds and to its group."""
    n = len(unit)
    draw = np.random.default_rng(seed).random(n)
    level = np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(links)).astype(int)
    order = np.argsort(-level, kind="stable")
    level = level[order]
    sizes = [int((level >= layer).sum()) for layer in range(level[0] + 1)]
    graph = Layers(np.ascontiguousarray(unit[order], np.float32), sizes, links)
    for layer in range(len(sizes) - 1, -1, -1):
        have = 1
        while have < sizes[layer]:
            new = np.arange(have, min(sizes[layer], have + min(TOGETHER, have)))
            points = graph.unit[new]
            beam, near = graph.walk(layer, points, graph.enter(points, layer), width, have)
            among = points @ points.T
            among[np.triu_indices(len(new))] = -np.inf  # earlier ones of the group only
            mates = np.where(np.isneginf(among), -1, new[None, :])
            keep = min(len(new), links)
            top = np.argsort(-among, axis=1, kind="stable")[:, :keep]
            beam = np.concatenate([beam, np.take_along_axis(mates, top, 1)], axis=1)
            near = np.concatenate([near, np.take_along_axis(among, top, 1)], axis=1)
            graph.link(layer, new, graph.choose(new, beam, near, links))
            have = int(new[-1]) + 1
    return graph, order


INDEX = "dim int, shard int, sizes array<int>, neighbours array<binary>, vectors binary, ids binary, id_ends binary"


def _shard_index(links: int, width: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h1", "h2"])
        raw = np.stack(pdf["vector"].to_list()).astype(np.float64)
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        graph, order = build(unit, seed, links, width)
        ids = [np.asarray(x, np.int64) for x in pdf["ids"]]
        ids = [ids[i] for i in order]
        return pd.DataFrame({
            "dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "sizes": [graph.sizes],
            "neighbours": [[x.tobytes() for x in graph.neighbours]], "vectors": [raw[order].tobytes()],
            "ids": [np.concatenate(ids).tobytes()], "id_ends": [np.cumsum([len(x) for x in ids]).astype(np.int64).tobytes()]})
    return run


def _shard_search(k: int, links: int, width: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"q1": [], "q2": [], "score": [], "vec_id": []}
        if len(index) and len(queries):
            row, dim = index.iloc[0], int(queries["dim"].iloc[0])
            raw = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
            norm = np.linalg.norm(raw, axis=1)
            flat = [np.frombuffer(x, np.int32) for x in row["neighbours"]]
            lists = [x.reshape(-1, links * (1 if layer else 2)) for layer, x in enumerate(flat)]
            graph = Layers((raw / norm[:, None]).astype(np.float32), list(row["sizes"]), links, lists)
            ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_ends"], np.int64)
            least = ids[np.concatenate(([0], ends[:-1]))]
            for at in range(0, len(queries), TOGETHER):
                part = queries.iloc[at : at + TOGETHER]
                asked = np.stack(part["vector"].to_list()).astype(np.float64)
                length = np.linalg.norm(asked, axis=1)
                beam, _ = graph.search((asked / length[:, None]).astype(np.float32), width)
                for q, (nodes, q1, q2) in enumerate(zip(beam, part["h1"], part["h2"])):
                    nodes = nodes[nodes >= 0]
                    if len(nodes) < min(k + 1, len(raw)):  # a part of the graph that the walk doesn't reach
                        nodes = np.arange(len(raw))
                    score = raw[nodes] @ asked[q] / (norm[nodes] * length[q])
                    best = np.lexsort((least[nodes], -score))[: k + 1]
                    for node, s in zip(nodes[best], score[best]):
                        for vec_id in ids[ends[node - 1] if node else 0 : ends[node]]:
                            out["q1"].append(q1)
                            out["q2"].append(q2)
                            out["score"].append(s)
                            out["vec_id"].append(vec_id)
        return pd.DataFrame(out).astype({"q1": "int64", "q2": "int64", "score": "float64", "vec_id": "int64"})
    return run


def nearest(
    embeddings: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, links: int = LINKS,
    build_width: int = BUILD_WIDTH, search_width: int = SEARCH_WIDTH, seed: int = SEED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for every query row, by cosine in double precision.

    Both tables have ``vec_id, embedding``; a query's own id is no candidate; ties go to the smaller id. Rows with a null
    id, and vectors that are null, empty, zero or hold a null or non-finite component, take no part; vectors meet those
    of their own length only; repeated rows count once; other columns are not used; an empty table gives no rows.

    A walk that finds fewer than k others where the shard has them is followed by a scan of the shard.
    Equal vectors are one node of the index. The index (a table of flat neighbour arrays, one row per shard of at most
    some ``shard_rows`` nodes) is written to the shared folder; blocks of query vectors then walk every shard, and the
    shards' results, scored on the original vectors, are merged.
    """
    def usable(df):
        real = df.select("vec_id", F.col("embedding").alias("vector")).where(F.col("vec_id").isNotNull() & vectors.finite(F.col("embedding")))
        return vectors.with_digest(real.where(F.exists("vector", lambda x: x != 0)).distinct(), "vector")

    groups = stage(vectors.equal_vectors(usable(embeddings), k + 1))
    shards = max(1, math.ceil(groups.count() / shard_rows))
    index = stage(
        groups.withColumn("shard", F.pmod(F.xxhash64("h1", "h2"), F.lit(shards)).cast("int"))
        .groupBy("dim", "shard").applyInPandas(_shard_index(links, build_width, seed), INDEX))
    asked = stage(usable(queries))
    asked_groups = stage(asked.groupBy("h1", "h2").agg(F.first("vector").alias("vector")).withColumn("dim", F.size("vector")))
    left, right = vectors.in_blocks(index, asked_groups, shards, max(1, math.ceil(asked_groups.count() / QUERY_BLOCK)))
    key = ["dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        _shard_search(k, links, search_width), "q1 long, q2 long, score double, vec_id long")
    asking = asked.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("vec_id").alias("query_id"))
    return vectors.top_ranks(found, asking, k)
