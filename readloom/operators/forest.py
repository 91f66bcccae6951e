"""Decision forests over feature rows, evaluated for all rows at once, with a file format of preorder nodes."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

#: Descriptors that a file begins with, by number of features.
DESCRIPTORS = {13: "13 extract_anchor_v3", 14: "14 extract_cands_v3"}


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: go left where the feature is at most the split. A side that is a leaf has child -1."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    left_value: np.ndarray
    right_value: np.ndarray

    def values(self, rows: np.ndarray) -> np.ndarray:
        out, node = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = node[open_]
            low = rows[open_, self.feature[at]] <= self.split[at]
            child = np.where(low, self.left[at], self.right[at])
            leaf = child < 0
            out[open_[leaf]] = np.where(low, self.left_value[at], self.right_value[at])[leaf]
            node[open_] = child
            open_ = open_[~leaf]
        return out


class Forest:
    """The mean of the trees' values; a change is made from the threshold on."""

    def __init__(self, trees: list[Tree], threshold: float = 0.5) -> None:
        if not trees:
            raise ValueError("a forest needs a tree")
        self.trees, self.threshold = trees, threshold

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return sum(t.values(rows) for t in self.trees) / len(self.trees)

    def decide(self, consensus: np.ndarray, row: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The row with the consensus where they differ and the forest agrees."""
        out = row.copy()
        differ = np.flatnonzero(consensus != row)
        take = differ[self.probability(features[differ]) >= self.threshold] if len(differ) else differ
        out[take] = consensus[take]
        return out


def _exactly(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError("the forest's file ends early")
    return data


def read_forest(path: str, features: int, most_trees: int | None = None, threshold: float = 0.5) -> Forest:
    """A file: length (u64) and text of the descriptor, number of trees (u32); per tree its number of nodes (u32), then in
    preorder feature (u8), split (f64), flags (u8: 2 left is a leaf, 1 right is) and per side its value (f32) or subtree."""
    with open(path, "rb") as f:
        (n,) = struct.unpack("<Q", _exactly(f, 8))
        if n > 1000:
            raise ValueError("this is no forest's file")
        text = _exactly(f, n).decode()
        if text != DESCRIPTORS[features]:
            raise ValueError(f"expected {DESCRIPTORS[features]!r}, found {text!r}")
        (count,) = struct.unpack("<I", _exactly(f, 4))
        trees = []
        for _ in range(count if most_trees is None else min(count, most_trees)):
            (size,) = struct.unpack("<I", _exactly(f, 4))
            nodes: list[list] = []
            waiting: list[tuple[int, int]] = [(-1, 0)]  # (parent, side) of the next node
            while waiting:
                parent, side = waiting.pop()
                at = len(nodes)
                if parent >= 0:
                    nodes[parent][2 + side] = at
                att, split, flag = struct.unpack("<BdB", _exactly(f, 10))
                nodes.append([att, split, -1, -1, 0.0, 0.0, flag])
                # a left leaf's value comes at once; a right one's after the left subtree, so it waits its turn
                if flag & 2:
                    (nodes[at][4],) = struct.unpack("<f", _exactly(f, 4))
                    if flag & 1:
                        (nodes[at][5],) = struct.unpack("<f", _exactly(f, 4))
                    else:
                        waiting.append((at, 1))
                else:
                    waiting.append((at, 3 if flag & 1 else 1))
                    waiting.append((at, 0))
                while waiting and waiting[-1][1] == 3:
                    (nodes[waiting.pop()[0]][5],) = struct.unpack("<f", _exactly(f, 4))
            if len(nodes) != size:
                raise ValueError("a tree's number of nodes differs")
            c = list(zip(*nodes))
            trees.append(Tree(np.array(c[0], np.int64), np.array(c[1], float), np.array(c[2], np.int64), np.array(c[3], np.int64), np.array(c[4], float), np.array(c[5], float)))
        return Forest(trees, threshold)


def write_forest(forest: Forest, path: str, features: int) -> None:
    def node(t: Tree, i: int) -> bytes:
        flag = 2 * (t.left[i] < 0) + (t.right[i] < 0)
        out = struct.pack("<BdB", t.feature[i], t.split[i], flag)
        for child, value in ((t.left[i], t.left_value[i]), (t.right[i], t.right_value[i])):
            out += struct.pack("<f", value) if child < 0 else node(t, child)
        return out

    text = DESCRIPTORS[features].encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text + struct.pack("<I", len(forest.trees)))
        for t in forest.trees:
            f.write(struct.pack("<I", len(t.feature)) + node(t, 0))
