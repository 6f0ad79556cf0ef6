"""Per-row Shapley attributions of fitted tree models.

The value of a set S of known features is the tree's answer when splits on other features send the row down both sides,
in proportion to the training weight of each side.  A leaf adds to that value

    answer * product over the path's distinct features of (1 if the row passes the feature's splits, for features in S;
                                                           the share z of weight that passes them, for the others)

so its Shapley values need only the path's features.  With o in {0, 1} for "the row passes" the value of feature i is

    answer * (o_i - z_i) * integral over t in 0..1 of the product over j != i of (o_j t + z_j (1 - t))

because the integral of t^s (1 - t)^(d-1-s) is the Shapley weight of a set of s out of d - 1 features.  The integrand is a
polynomial of degree d - 1: Gauss-Legendre nodes give it exactly, and no subset is ever enumerated.  Contributions plus
base equal the model's output for every row.

Where only one output's contributions are asked for (``tree_top_features``), neighbouring leaves are scored together: the
effects of all leaves under a node follow from few conditions, so they are summed in a table of the conditions' patterns and
a row adds one entry per feature for all these leaves.

The nodes are read from the saved model.  Rows are scored in Arrow batches where they lie, without a shuffle; what each
task receives is the model.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    OneVsRestModel,
    RandomForestClassificationModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import constants as C
from ..llm.common import importable_on_workers
from ..sources.tables import ensure_checkpoint_dir
from .models import FittedModel

BATCH_ROWS = 2048       # rows scored at once
PATTERN_FEATURES = 12   # paths of more features are not scored by patterns
DIRECT_ROWS = 1024      # their rows are scored so many at once: the work arrays are rows x path features x nodes
GROUP_BITS = 11         # conditions of leaves that are scored together
GROUP_ROWS = 1 << 15    # rows that share the tables
GROUP_CELLS = 1 << 22   # rows x features of them


@dataclass(frozen=True)
class Node:
    """A node of a fitted tree: children are None in a leaf; ``cover`` is the training weight that reached it."""

    stats: tuple[float, ...]
    prediction: float
    cover: float
    left: int | None = None
    right: int | None = None
    feature: int = -1
    threshold: float = 0.0
    categories: tuple[float, ...] | None = None      # a categorical split's left side

    def goes_left(self, x: np.ndarray) -> np.ndarray:
        value = x[:, self.feature]
        return value <= self.threshold if self.categories is None else np.isin(value, self.categories)


@dataclass(frozen=True)
class Leaf:
    """Edges (node, to the left?) by feature, the share of weight that passes each feature's splits, the answer."""

    edges: tuple[tuple[int, tuple[tuple[int, bool], ...]], ...]
    shares: tuple[float, ...]
    answer: np.ndarray


@dataclass(frozen=True)
class Tree:
    nodes: dict[int, Node]
    leaves: tuple[Leaf, ...]


@dataclass(frozen=True)
class Group:
    """The leaves under one node.  ``conditions``: edges that a row passes or not, a bit each, of the path to the node (by
    feature) and of the splits below it (to the left).  Each leaf has, by feature, the bits that must be on or off."""

    conditions: tuple[tuple[tuple[int, bool], ...], ...]
    leaves: tuple[tuple[Leaf, tuple[tuple[tuple[int, bool], ...], ...]], ...]

    def codes(self, left: dict[int, np.ndarray], rows: int) -> np.ndarray:
        """The pattern of conditions that each row meets."""
        code = np.zeros(rows, np.intp)
        for j, edges in enumerate(self.conditions):
            passes = [left[i] if to_left else ~left[i] for i, to_left in edges]
            code |= (np.logical_and.reduce(passes) if len(passes) > 1 else passes[0]).astype(np.intp) << j
        return code

    def table(self, patterns: np.ndarray, outputs: int) -> dict[int, np.ndarray]:
        """feature -> outputs x patterns: the sum of the leaves' effects."""
        bits = [(patterns >> j) & 1 == 1 for j in range(len(self.conditions))]
        sides = {(j, on): bit if on else ~bit for j, bit in enumerate(bits) for on in (True, False)}
        found: dict[int, np.ndarray] = {}
        for leaf, needed in self.leaves:
            passes = [np.logical_and.reduce([sides[b] for b in some]) if len(some) > 1 else sides[some[0]]
                      for some in needed]
            for (feature, _), effect in zip(leaf.edges, _effects(passes, np.array(leaf.shares))):
                total = found.setdefault(feature, np.zeros((outputs, len(patterns))))
                for k, answer in enumerate(leaf.answer):
                    if answer:
                        total[k] += effect * answer
        return found


def _groups(tree: Tree) -> list[Group]:
    """The tree's leaves in groups under the highest nodes that have at most ``GROUP_BITS`` conditions."""
    order, stack = [], [0]                              # inner nodes last to first, leaves as ``_grow`` lists them
    at_leaf: dict[int, Leaf] = {}
    leaves = iter(tree.leaves)
    while stack:
        i = stack.pop()
        node = tree.nodes[i]
        if node.left is None:
            at_leaf[i] = next(leaves)
        else:
            order.append(i)
            stack += [node.left, node.right]
    below: dict[int, list[int]] = {i: [] for i in at_leaf}
    for i in reversed(order):
        below[i] = [i, *below[tree.nodes[i].left], *below[tree.nodes[i].right]]
    out: list[Group] = []
    open_nodes: list[tuple[int, dict[int, tuple[tuple[int, bool], ...]]]] = [(0, {})]
    while open_nodes:
        top, path = open_nodes.pop()
        node = tree.nodes[top]
        if node.left is not None and len(path) + len(below[top]) > GROUP_BITS:
            for child, to_left in ((node.left, True), (node.right, False)):
                open_nodes.append((child, path | {node.feature: (*path.get(node.feature, ()), (top, to_left))}))
            continue
        of_path = {f: j for j, f in enumerate(path)}
        of_node = {i: len(path) + j for j, i in enumerate(below[top])}
        members = []
        for i in [top] if node.left is None else [c for b in below[top] for c in (tree.nodes[b].left, tree.nodes[b].right)
                                                  if c in at_leaf]:
            needed = []
            for feature, edges in at_leaf[i].edges:
                known = len(path.get(feature, ()))
                needed.append((*(((of_path[feature], True),) if known else ()),
                               *((of_node[b], to_left) for b, to_left in edges[known:])))
            members.append((at_leaf[i], tuple(needed)))
        out.append(Group((*path.values(), *(((i, True),) for i in below[top])), tuple(members)))
    return out


@dataclass(frozen=True)
class AdditiveTrees:
    """A sum of trees, each answering one value per output."""

    trees: tuple[Tree, ...]
    outputs: int

    def base(self) -> np.ndarray:
        """The answer with no feature known."""
        total = np.zeros(self.outputs)
        for tree in self.trees:
            for leaf in tree.leaves:
                total += np.prod(leaf.shares) * leaf.answer
        return total

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """rows x outputs x features."""
        out = np.zeros((x.shape[1], self.outputs, x.shape[0]))
        for tree in self.trees:
            left = {i: n.goes_left(x) for i, n in tree.nodes.items() if n.left is not None}
            sides = {(i, to_left): passes if to_left else ~passes for i, passes in left.items() for to_left in (True, False)}
            for leaf in tree.leaves:
                if not leaf.edges:
                    continue
                passes = [np.logical_and.reduce([sides[e] for e in edges]) if len(edges) > 1 else sides[edges[0]]
                          for _, edges in leaf.edges]
                for (feature, _), effect in zip(leaf.edges, _effects(passes, np.array(leaf.shares))):
                    for k, answer in enumerate(leaf.answer):
                        if answer:
                            out[feature, k] += effect * answer
        return out.transpose(2, 1, 0)

    def answers(self, x: np.ndarray) -> np.ndarray:
        """rows x outputs: the sum of the trees' answers."""
        total = np.zeros((x.shape[0], self.outputs))
        rows = np.arange(x.shape[0])
        for tree in self.trees:
            inner = [i for i, n in tree.nodes.items() if n.left is not None]
            place = {i: j for j, i in enumerate(inner)}
            leaves, stack = [], [0]
            while stack:
                i = stack.pop()
                if i in place:
                    stack += [tree.nodes[i].left, tree.nodes[i].right]
                else:
                    place[i] = len(inner) + len(leaves)
                    leaves.append(i)
            now = np.full(x.shape[0], place[0])
            if inner:
                left = np.stack([tree.nodes[i].goes_left(x) for i in inner])
                child = np.array([[place[tree.nodes[i].right], place[tree.nodes[i].left]] for i in inner])
                open_rows = rows
                while open_rows.size:
                    at = now[open_rows]
                    now[open_rows] = child[at, left[at, open_rows].astype(np.intp)]
                    open_rows = open_rows[now[open_rows] < len(inner)]
            total += np.array([leaf.answer for leaf in tree.leaves])[now - len(inner)]
        return total

    def contributions_to(self, x: np.ndarray, output: np.ndarray, groups: Sequence[list[Group]] | None = None) -> np.ndarray:
        """rows x features: the contributions to each row's own output.  ``groups``: of each tree, where known."""
        order = np.argsort(output, kind="stable")
        x = np.asfortranarray(x[order])
        ends = np.searchsorted(output[order], np.arange(self.outputs + 1))
        parts = [slice(a, b) for a, b in zip(ends, ends[1:])]
        rows = x.shape[0]
        out = np.zeros((x.shape[1], rows))
        for tree, some in zip(self.trees, groups or [_groups(t) for t in self.trees]):
            left = {i: n.goes_left(x) for i, n in tree.nodes.items() if n.left is not None}
            for group in some:
                if not group.conditions:
                    continue
                code = group.codes(left, rows)
                if 1 << len(group.conditions) <= rows:
                    patterns = np.arange(1 << len(group.conditions))
                else:
                    patterns, code = np.unique(code, return_inverse=True)
                codes = [code[part] for part in parts]
                for feature, table in group.table(patterns, self.outputs).items():
                    for part, line, at in zip(parts, table, codes):
                        out[feature, part] += line.take(at, mode="clip")    # all are within: no check
        back = np.empty_like(out)
        back[:, order] = out
        return back.T


def _effects(passes: list[np.ndarray], shares: np.ndarray) -> list[np.ndarray]:
    """For each feature of a path its effect in each row.

    The effects depend on which of the path's features a row passes, so they are computed once for each such pattern that
    occurs and looked up for the rows.
    """
    d, rows = len(passes), len(passes[0])
    if d > PATTERN_FEATURES:
        each = [np.stack([p[i: i + DIRECT_ROWS] for p in passes], axis=1).astype(np.float64)
                for i in range(0, rows, DIRECT_ROWS)]
        return list(np.concatenate([(e - shares) * _others(e, shares) for e in each]).T)
    code = passes[0].astype(np.intp)
    for j in range(1, d):
        code |= passes[j].astype(np.intp) << j
    met = np.flatnonzero(np.bincount(code, minlength=1 << d))
    pattern = ((met[:, None] >> np.arange(d)) & 1).astype(np.float64)
    table = np.ascontiguousarray(((pattern - shares) * _others(pattern, shares)).T)
    place = np.zeros(1 << d, np.intp)
    place[met] = np.arange(met.size)
    code = place[code]
    return [line[code] for line in table]


@cache
def _quadrature(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights over 0..1."""
    points, weights = np.polynomial.legendre.leggauss(n)
    return (points + 1) / 2, weights / 2


def _others(passes: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """For each row and feature the integral of the product of the other features' factors."""
    d = shares.size
    t, weights = _quadrature((d + 1) // 2)
    factors = passes[:, :, None] * t + shares[None, :, None] * (1 - t)
    # products before and after each feature: dividing the whole product would fail for a share of zero
    before = np.ones_like(factors)
    after = np.ones_like(factors)
    for j in range(1, d):
        before[:, j] = before[:, j - 1] * factors[:, j - 1]
        after[:, d - 1 - j] = after[:, d - j] * factors[:, d - j]
    return (before * after) @ weights


def _grow(nodes: dict[int, Node], answer) -> Tree:
    """The tree's leaves with their paths; ``answer`` maps a leaf node to its values."""
    leaves: list[Leaf] = []
    open_paths: list[tuple[int, dict[int, list[tuple[int, bool]]], dict[int, float]]] = [(0, {}, {})]
    while open_paths:
        i, edges, shares = open_paths.pop()
        node = nodes[i]
        if node.left is None:
            leaves.append(Leaf(tuple((f, tuple(e)) for f, e in edges.items()), tuple(shares.values()),
                               np.asarray(answer(node), dtype=np.float64)))
            continue
        for child, to_left in ((node.left, True), (node.right, False)):
            part = nodes[child].cover / node.cover if node.cover else 0.0
            open_paths.append((child, edges | {node.feature: [*edges.get(node.feature, []), (i, to_left)]},
                               shares | {node.feature: shares.get(node.feature, 1.0) * part}))
    return Tree(nodes, tuple(leaves))


def saved_nodes(spark: SparkSession, model, folder: str | None = None) -> list[dict[int, Node]]:
    """Nodes of each tree of a fitted Spark ML tree model, from its saved form.  The rows are the model's own size."""
    path = f"{(folder or ensure_checkpoint_dir(spark)).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    table = spark.read.parquet(f"{path}/data")
    if "nodeData" in table.columns:
        table = table.select("treeID", "nodeData.*")
    else:
        table = table.withColumn("treeID", F.lit(0))
    of_classes = isinstance(model, DecisionTreeClassificationModel | RandomForestClassificationModel)
    trees: dict[int, dict[int, Node]] = {}
    for r in table.collect():
        stats = tuple(r["impurityStats"])
        cover = sum(stats) if of_classes else stats[0]        # class weights, or (weight, sum, sum of squares)
        split = r["split"]
        if r["leftChild"] < 0:
            node = Node(stats, r["prediction"], cover)
        else:
            continuous = split["numCategories"] == -1
            sides = tuple(split["leftCategoriesOrThreshold"])
            node = Node(stats, r["prediction"], cover, r["leftChild"], r["rightChild"], split["featureIndex"],
                        sides[0] if continuous else 0.0, None if continuous else sides)
        trees.setdefault(r["treeID"], {})[r["id"]] = node
    return [trees[i] for i in sorted(trees)]


def additive_trees(spark: SparkSession, model, folder: str | None = None) -> AdditiveTrees:
    """The sum of trees behind a fitted model.

    Outputs: class probabilities of a tree or forest classifier, the prediction of a tree, forest or boosted regressor,
    the raw margin of a boosted binary classifier (one output), the classes' margins of one-vs-rest boosted trees.
    """
    if isinstance(model, OneVsRestModel):
        parts = [additive_trees(spark, m, folder) for m in model.models]
        n = len(parts)
        return AdditiveTrees(tuple(
            Tree(t.nodes, tuple(Leaf(leaf.edges, leaf.shares, np.eye(n)[k] * leaf.answer) for leaf in t.leaves))
            for k, part in enumerate(parts) for t in part.trees), n)
    nodes = saved_nodes(spark, model, folder)
    if isinstance(model, DecisionTreeClassificationModel | RandomForestClassificationModel):
        def answer(node: Node) -> np.ndarray:
            stats = np.array(node.stats)
            return stats / (stats.sum() or 1.0) / len(nodes)

        return AdditiveTrees(tuple(_grow(t, answer) for t in nodes), model.numClasses)
    if isinstance(model, DecisionTreeRegressionModel | RandomForestRegressionModel):
        scale = [1.0 / len(nodes)] * len(nodes)
    elif isinstance(model, GBTClassificationModel | GBTRegressionModel):
        scale = list(model.treeWeights)
    else:
        raise TypeError(f"not a tree model: {type(model).__name__}")
    return AdditiveTrees(tuple(_grow(t, lambda node, s=s: [s * node.prediction]) for t, s in zip(nodes, scale)), 1)


def _per_row(df: DataFrame, ensemble: AdditiveTrees, key: Sequence[str], features: str) -> DataFrame:
    """key..., outputs: an array of (output, order, cls, base, contributions), null where the features are null."""
    base = [float(b) for b in ensemble.base()]

    @F.pandas_udf("array<double>")
    def flat(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.full(len(batch), None, dtype=object)
            there = np.flatnonzero(batch.notna().to_numpy())
            for start in range(0, there.size, BATCH_ROWS):
                at = there[start:start + BATCH_ROWS]
                parts = ensemble.contributions(np.vstack(batch.iloc[at].to_numpy()).astype(np.float64))
                for i, row in zip(at, parts.reshape(at.size, -1)):
                    out[i] = row
            yield pd.Series(out)

    array = F.when(F.col(features).isNotNull(), vector_to_array(features))
    scored = df.select(*key, flat(array).alias("all_parts"))
    width = (F.size("all_parts") / ensemble.outputs).cast("int")
    bases = F.array(*[F.lit(b) for b in base])
    parts = F.transform(F.sequence(F.lit(0), F.lit(ensemble.outputs - 1)), lambda k: F.struct(
        k.alias("cls"), F.element_at(bases, k + 1).alias("base"),
        F.slice("all_parts", k * width + 1, width).alias("contributions")))
    outputs = F.transform(parts, lambda s: F.struct(
        F.aggregate(s["contributions"], s["base"], lambda a, b: a + b).alias("output"), (-s["cls"]).alias("order"),
        s["cls"].alias("cls"), s["base"].alias("base"), s["contributions"].alias("contributions")))
    return scored.select(*key, F.when(F.col("all_parts").isNotNull(), outputs).alias("outputs"))


def tree_contributions(df: DataFrame, ensemble: AdditiveTrees, key: Sequence[str],
                       features: str = "features") -> DataFrame:
    """key..., cls, base, contributions (one per feature), output (their sum and base): one row per input row and output.

    A row with null features keeps one row of nulls.  A narrow transform: no shuffle.
    """
    return _per_row(df, ensemble, key, features).select(*key, F.explode_outer("outputs").alias("s")).select(
        *key, "s.cls", "s.base", "s.contributions", "s.output")


def tree_top_features(df: DataFrame, model: FittedModel, key: str, n: int = C.TOP_ATTRIBUTIONS) -> DataFrame:
    """key, predicted, base, output, top: the n largest |contribution| to the class of the largest output (the first of
    equals; equal contributions: feature name).  Picked and sorted inside each task, without a shuffle.  A row with null
    features keeps a row of nulls."""
    importable_on_workers(df.sparkSession)
    ensemble = additive_trees(df.sparkSession, model.pipeline.stages[-1])
    names = model.feature_names()
    ready = model.transform(df, keep_features=True)
    ready = ready.select(key, F.when(F.col("features").isNotNull(), vector_to_array("features")).alias("x"))
    top_type = "array<struct<feature:string,contribution:double>>"
    added = StructType.fromDDL(f"predicted int, base double, output double, top {top_type}")
    schema = StructType([ready.schema[key], *added])
    return ready.mapInArrow(_top_fn(ensemble, names, key, n, to_arrow_schema(schema)), schema)


def _top_fn(ensemble: AdditiveTrees, names: Sequence[str], key: str, n: int, schema: pa.Schema):
    base = ensemble.base()
    by_name = np.array(sorted(range(len(names)), key=lambda i: names[i].encode()), dtype=np.intp)
    named = pa.array([names[i] for i in by_name], pa.string())

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [_groups(t) for t in ensemble.trees]
        at_once = max(DIRECT_ROWS, min(GROUP_ROWS, GROUP_CELLS // max(len(names), 1)))

        def scored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            rows, vectors = table.num_rows, table.column("x").combine_chunks()
            known = vectors.is_valid().to_numpy(zero_copy_only=False)
            x = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(known.sum(), -1)
            answers = ensemble.answers(x)
            own = answers.argmax(axis=1)
            parts = ensemble.contributions_to(x, own, groups)[:, by_name]
            first = np.argsort(-np.abs(parts), axis=1, kind="stable")[:, :n]
            value = np.take_along_axis(parts, first, axis=1)
            place = np.full(rows, -1)
            place[known] = np.arange(len(x))
            at = pa.array(place, mask=~known)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * first.shape[1]),
                pa.StructArray.from_arrays([named.take(pa.array(first.ravel())), pa.array(value.ravel())],
                                           names=["feature", "contribution"]))
            best = [pa.array(own.astype(np.int32)), pa.array(base[own]),
                    pa.array(np.take_along_axis(answers, own[:, None], axis=1).ravel()), lists]
            return pa.RecordBatch.from_arrays([table.column(key).combine_chunks(), *(c.take(at) for c in best)],
                                              names=schema.names).cast(schema)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= at_once:
                yield scored(held)
                held, size = [], 0
        if size:
            yield scored(held)

    return fn


def mean_abs_contributions(contributions: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature, cls, mean_abs over all rows of ``tree_contributions`` (rows without features are left out)."""
    named = F.arrays_zip(F.array(*[F.lit(x) for x in names]).alias("feature"), F.col("contributions").alias("value"))
    long = contributions.where(F.col("contributions").isNotNull()).select("cls", F.explode(named).alias("s"))
    return long.groupBy(F.col("s.feature").alias("feature"), "cls").agg(F.avg(F.abs("s.value")).alias("mean_abs"))
