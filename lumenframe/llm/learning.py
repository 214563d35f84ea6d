"""What the two classifiers share: a bounded sample of labelled rows, and byte-class counts of a text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, id_and_text

#: Classes of bytes whose shares are features. Bytes of 128 and more are parts of other letters.
CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "space": b" \t\n\x0b\x0c\r", "line": b"\n",
    "stop": b".,;:?", "shout": b"!", "quote": b"'\"`", "symbol": b"#*$%&|<>", "bar": b"|", "bracket": b"()[]{}", "other": b"@^_~=+-/\\",
    "high": bytes(range(128, 256)), "control": bytes([*range(9), *range(14, 32), 127]),
}
_MEMBER = np.zeros((256, len(CLASSES)))
for _k, _v in enumerate(CLASSES.values()):
    _MEMBER[list(_v), _k] = 1


def class_counts(data: bytes) -> np.ndarray:
    """Bytes of each class."""
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _MEMBER


def labelled_sample(docs: DataFrame, labels: DataFrame, mark: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` training ids of each class: those of least hash, so the choice is the same each time.

    Rows whose crc32 leaves ``held_out`` are never taken. Null ids and labels are left out; an id with both labels counts as 1.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = marks.filter(crc32_mod("doc_id", modulus) != held_out)
    chosen = [marks.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    # at most 2 * most rows of 12 bytes: a proven bound for the broadcast
    return id_and_text(docs).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")


def one_per_id(features: DataFrame) -> DataFrame:
    """One row of (label, x) for each id, so that repeated rows cannot outgrow the sample's bound."""
    return features.groupBy("doc_id").agg(F.max(F.struct("label", "x")).alias("r")).select("doc_id", "r.label", "r.x")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
