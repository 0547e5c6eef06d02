"""Secret scan: fixed patterns, and a character convolutional network over every long token."""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh3_64_intdigest

from lakeqa.llm.decontaminate import replace_spans, replaced_length
from lakeqa.scale import cut_lineage, small_batches

# Fixed values of the contract: patterns and least lengths, in the order in which kinds are listed.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I
)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")

# A candidate is a run of at least this many token characters; every one is scored.
LEAST_RUN = 16
CONTEXT, SEGMENT = 16, 48
WIDTH = CONTEXT + SEGMENT + CONTEXT
# Windows of each kind of finding, and windows that none touches, that one shard of the training has; every
# window is in a shard.
KIND_WINDOWS = 5_000
PLAIN_WINDOWS = 15_000
EPOCHS, ROUNDS = 6, 3
# Weights are averaged as integers of this unit.
WEIGHT_UNIT = 1 << 32
# Distinct windows that a task holds before it hands them on.
HELD_WINDOWS = 1 << 16
# A kind with at least five times so many windows has a fifth held out, others the one with the smallest digest.
LEAST_SPLIT = 5
# Held-out logits are counted in steps between these bounds.
LOGIT_STEPS, LOGIT_BOUND = 256, 64
LEAST_RECALL = 0.98
LEAST_SCORE = 0.5

_TOKEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_RUNS = bytes(0x78 if c in _TOKEN else 0x20 for c in range(256))
_CODES = bytes(min(c, 128) + 1 for c in range(256))  # 0 is beyond the text
_RUN = b"x" * LEAST_RUN
FINDINGS = "array<struct<kind:string,start:bigint,end:bigint>>"
MASKS = "array<struct<start:bigint,end:bigint>>"


def token_runs(body: bytes) -> list[tuple[int, int]]:
    """Byte spans of the runs of at least LEAST_RUN token characters."""
    marked, runs, at = body.translate(_RUNS), [], 0
    while (at := marked.find(_RUN, at)) >= 0:
        end = marked.find(b" ", at)
        end = len(marked) if end < 0 else end
        runs.append((at, end))
        at = end
    return runs


def base_findings(body: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in bytes. Access keys and hex runs lie inside token runs."""
    found = []
    low = body.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(body) if len(m[2]) >= 6]
    for start, end in runs:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(body, start, end)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(body, start, end)]
    return sorted(found)


def segments_of(body: bytes, start: int, end: int) -> list[tuple[int, bytes]]:
    """A candidate in segments: the number of characters before each, and these, it and those after it."""
    out = []
    for at in range(start, end, SEGMENT):
        left = max(0, at - CONTEXT)
        out.append((at - left, body[left : min(at + SEGMENT, end) + CONTEXT]))
    return out


def codes_of(before: int, piece: bytes) -> bytes:
    return (bytes(CONTEXT - before) + piece.translate(_CODES)).ljust(WIDTH, b"\0")


def windows_of(body: bytes, start: int, end: int) -> list[bytes]:
    """Codes of a candidate in segments, each with the characters around it."""
    return [codes_of(*segment) for segment in segments_of(body, start, end)]


class CharNet:
    """Embedding, one convolution, the maximum over places, one logit; then scale and shift."""

    def __init__(self, seed: int = 7, embed: int = 8, taps: int = 5, filters: int = 24):
        draw = np.random.default_rng(seed)
        make = lambda *shape: (draw.normal(size=shape) * (2 / shape[0]) ** 0.5).astype(np.float32)
        self.taps = taps
        self.weights = [make(130, embed), make(taps * embed, filters), np.zeros(filters, np.float32), make(filters, 1), np.zeros(1, np.float32)]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.0

    def _forward(self, codes: np.ndarray):
        table, kernel, bias, out, base = self.weights
        embedded = table[codes]
        steps = codes.shape[1] - self.taps + 1
        columns = np.concatenate([embedded[:, k : k + steps] for k in range(self.taps)], axis=2)
        layer = columns @ kernel + bias
        top = layer.argmax(axis=1)
        peak = np.maximum(np.take_along_axis(layer, top[:, None, :], axis=1)[:, 0], 0)
        return columns, top, peak, (peak @ out + base)[:, 0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[i : i + 512])[3] for i in range(0, len(codes), 512)]
        return np.concatenate(parts) if parts else np.empty(0, np.float32)

    def chances(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit.astype(np.float64) + self.shift, -30, 30)))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.chances(self.logits(codes))

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 3e-3, seed: int = 7):
        """Adam on the logistic loss, classes weighted alike; half of the windows lose their context."""
        draw = np.random.default_rng(seed)
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights]
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        weight = np.minimum(weight, 20).astype(np.float32)
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(draw.permutation(len(codes)), max(1, len(codes) // batch)):
                x = codes[rows].copy()
                blind = draw.random(len(rows)) < 0.5
                x[blind, :CONTEXT] = 0
                x[blind, CONTEXT + SEGMENT :] = 0
                columns, top, peak, logit = self._forward(x)
                slope = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
                table, kernel, _, out, _ = self.weights
                into = (slope[:, None] * out[:, 0]) * (peak > 0)
                picked = np.take_along_axis(columns[:, :, None, :], top[:, None, :, None], axis=1)[:, 0]
                grads = [np.zeros_like(table), np.einsum("nfk,nf->kf", picked, into), into.sum(0), peak.T @ slope[:, None], slope.sum(keepdims=True)]
                back = (into[:, :, None] * kernel.T[None]).reshape(len(rows), into.shape[1], self.taps, -1)
                for k in range(self.taps):
                    places = np.take_along_axis(x, top + k, axis=1)
                    np.add.at(grads[0], places.ravel(), back[:, :, k].reshape(-1, table.shape[1]))
                step += 1
                for w, g, m in zip(self.weights, grads, moments, strict=True):
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    w -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        return self

    def calibrate(self, logit: np.ndarray, labels: np.ndarray, kinds: np.ndarray, count: np.ndarray, least_recall: float = LEAST_RECALL):
        """Scale and shift by logistic regression of held-out labels, ``count`` windows of each logit and kind,
        sorted by them; then the largest threshold that still finds ``least_recall`` of the held-out
        findings of every kind (LEAST_SCORE without any)."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
            v = count * (p * (1 - p) + 1e-6)
            off = count * (p - labels)
            gradient = np.array([(off * logit).sum() + 1e-2 * (a - 1), off.sum() + 1e-2 * b])
            curve = np.array([[(v * logit * logit).sum() + 1e-2, (v * logit).sum()], [(v * logit).sum(), v.sum() + 1e-2]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(curve, gradient), -1, 1)
        self.scale, self.shift = float(max(a, 1e-3)), float(b)
        scores = self.chances(logit)
        bounds = []
        for kind in np.unique(kinds[labels == 1]):
            own, upto = scores[kinds == kind], np.cumsum(count[kinds == kind])
            bounds.append(own[np.searchsorted(upto, np.floor((1 - least_recall) * upto[-1]), "right")])
        self.threshold = float(min(bounds, default=LEAST_SCORE))
        return self


def labelled(body: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(kind, digest, characters before, window) of a text's segments; -1 is the kind of runs without a finding.

    A segment that a finding touches has its kind; the other segments of such a run are neither.
    """
    runs = token_runs(body)
    found = base_findings(body, runs)
    first = 0
    tops = np.maximum.accumulate([b for _, _, b in found]) if found else ()
    for start, end in runs:
        while first < len(found) and tops[first] <= start:
            first += 1
        here, at = [], first
        while at < len(found) and found[at][0] < end:
            if found[at][2] > start:
                here.append(found[at])
            at += 1
        for place, (before, piece) in zip(range(start, end, SEGMENT), segments_of(body, start, end), strict=True):
            stop = min(place + SEGMENT, end)
            kind = next((k for a, k, b in here if a < stop and place < b), -1) if here else -1
            if kind >= 0 or not here:
                yield kind, xxh3_64_intdigest(piece, seed=before * 8 + kind + 1), before, piece


def train(docs: DataFrame, text: str = "text", kind_windows: int = KIND_WINDOWS, plain_windows: int = PLAIN_WINDOWS) -> CharNet | None:
    """The network, from all labelled windows of all documents; None only if no document has a finding.

    Labels are what the fixed patterns find. Every distinct window of each kind, and of runs without a
    finding, is learned from or, for a fifth of each kind, held out for calibration; one at least is held
    out, and a kind with a single window has it in both parts. Windows are dealt by digest into shards of
    about ``kind_windows`` a kind and ``plain_windows`` others; a kind with fewer is in every shard. The
    shards are learned from side by side in tasks, from common weights, which are then averaged, ROUNDS
    times. Nothing depends on partitions.
    """
    limits = {k: plain_windows if k < 0 else kind_windows for k in range(-1, 3)}
    schema = pa.schema([("kind", pa.int64()), ("digest", pa.int64()), ("codes", pa.binary())])

    def rows_of(held: dict[tuple[int, int], tuple[int, bytes]]) -> pa.RecordBatch:
        kinds, digests = (np.array([key[i] for key in held], np.int64) for i in (0, 1))
        codes = [codes_of(*window) for window in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(digests), pa.array(codes, pa.binary())], schema=schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[int, int], tuple[int, bytes]] = {}
            for body in batch.column(0):
                for kind, digest, before, piece in labelled(body.as_py() or b""):
                    held[kind, digest >> 1] = before, piece
                    if len(held) >= HELD_WINDOWS:
                        yield rows_of(held)
                        held.clear()
            yield rows_of(held)

    found = docs.select(F.col(f"`{text}`").cast("binary")).mapInArrow(label, "kind bigint, digest bigint, codes binary")
    with small_batches(docs.sparkSession):
        found = cut_lineage(found.groupBy("kind", "digest").agg(F.min("codes").alias("codes")))
    counts = {r["kind"]: (r["n"], r["least"]) for r in found.groupBy("kind").agg(F.count("*").alias("n"), F.min("digest").alias("least")).collect()}
    if not any(k >= 0 for k in counts):
        return None
    shards = max(-(-n // limits[k]) for k, (n, _) in counts.items())
    place = F.pmod(F.xxhash64("digest"), F.lit(shards))
    held_out, dealt = F.lit(False), F.array(place)
    single = [k for k, (n, _) in counts.items() if n == 1]
    for kind, (n, least) in counts.items():
        own = F.col("digest") == least
        if n >= 5 * LEAST_SPLIT:
            own = own | (F.col("digest") % 5 == 0)
        held_out = held_out | ((F.col("kind") == kind) & own)
        if n <= limits[kind] and shards > 1:
            dealt = F.when(F.col("kind") == kind, F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).otherwise(dealt)
    learned = found.where(~held_out | F.col("kind").isin(single)).withColumn("shard", F.explode(dealt))
    learned = cut_lineage(learned.repartition(shards, "shard"))
    net, rounds = CharNet(), 1 if shards == 1 else ROUNDS
    for turn in range(rounds):
        net.weights = _averaged(learned, net, shards, EPOCHS // rounds, turn)
    return _calibrated(found.where(held_out), net)


def _averaged(windows: DataFrame, net: CharNet, shards: int, epochs: int, turn: int) -> list[np.ndarray]:
    """The mean of what each shard makes of the weights of ``net``; sums are of integers, so in any order the same."""
    start = windows.sparkSession.sparkContext.broadcast(net)
    ends = np.cumsum([w.size for w in net.weights])

    def learn(shard: pa.Table) -> pa.Table:
        order = np.lexsort((shard.column("digest").to_numpy(), shard.column("kind").to_numpy()))
        codes = _codes_table(shard.column("codes"))[order]
        labels = (shard.column("kind").to_numpy()[order] >= 0).astype(np.float64)
        own = copy.deepcopy(start.value).fit(codes, labels, epochs, seed=7 + turn)
        flat = np.concatenate([w.ravel() for w in own.weights]).astype(np.float64)
        return pa.table({"place": np.arange(len(flat)), "value": np.round(flat * WEIGHT_UNIT).astype(np.int64)})

    made = windows.groupBy("shard").applyInArrow(learn, "place bigint, value bigint")
    flat = np.zeros(int(ends[-1]))
    for row in made.groupBy("place").agg(F.sum("value").alias("value")).collect():
        flat[row["place"]] = row["value"] / (shards * WEIGHT_UNIT)
    start.destroy()
    return [part.reshape(w.shape).astype(np.float32) for part, w in zip(np.split(flat, ends[:-1]), net.weights, strict=True)]


def _codes_table(codes: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _calibrated(held_out: DataFrame, net: CharNet) -> CharNet:
    """``net`` with scale, shift and threshold from all held-out windows, counted by kind and logit step."""
    sent = held_out.sparkSession.sparkContext.broadcast(net)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logit = np.clip(sent.value.logits(_codes_table(batch.column(1))), -LOGIT_BOUND, LOGIT_BOUND)
            step = np.floor(logit.astype(np.float64) * LOGIT_STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(step)], names=["kind", "step"])

    counted = held_out.select("kind", "codes").mapInArrow(steps, "kind bigint, step bigint").groupBy("kind", "step").count()
    # At most a row for each kind and step, however many windows there are.
    rows = np.array(sorted(tuple(r) for r in counted.collect()), np.int64)
    sent.destroy()
    kinds, step, count = rows.T
    return net.calibrate(step / LOGIT_STEPS, (kinds >= 0).astype(np.float64), kinds, count)


def uncovered(runs: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of runs that no finding covers, of at least LEAST_RUN characters; whole runs among them."""
    if not found:
        return runs
    out, covers, at = [], [], 0
    for a, _, b in found:  # sorted
        if covers and a <= covers[-1][1]:
            covers[-1][1] = max(b, covers[-1][1])
        else:
            covers.append([a, b])
    for start, end in runs:
        while at < len(covers) and covers[at][1] <= start:
            at += 1
        left, k = start, at
        while k < len(covers) and covers[k][0] < end:
            if covers[k][0] - left >= LEAST_RUN:
                out.append((left, covers[k][0]))
            left = covers[k][1]
            k += 1
        if end - left >= LEAST_RUN:
            out.append((left, end))
    return out


def find_secrets(docs: DataFrame, net: CharNet | None, text: str = "text") -> DataFrame:
    """Adds ``findings`` (kind, start, end in code points) and ``masks`` (their union) to ``docs``.

    Columns of those names are replaced; null and empty texts have no findings. Every run of at
    least LEAST_RUN token characters is a candidate, or of a run that patterns found in, every part of
    that length which they leave uncovered; those that the network scores at its threshold or above
    are findings of kind ``model``. Rows don't move.
    """
    kept = [c for c in docs.columns if c not in ("findings", "masks")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    span = [("start", pa.int64()), ("end", pa.int64())]
    kinds = (pa.list_(pa.struct([("kind", pa.string()), *span])), pa.list_(pa.struct(span)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = dict(zip(batch.schema.names, batch.columns, strict=True))
            findings, masks = [], []
            bodies = [b or b"" for b in held[text].cast(pa.binary()).to_pylist()]
            runs = [token_runs(b) for b in bodies]
            known = [base_findings(b, own) for b, own in zip(bodies, runs, strict=True)]
            rest = [uncovered(own, found) for own, found in zip(runs, known, strict=True)]
            scores = _run_scores(bodies, rest, net)
            for body, found, own, values in zip(bodies, known, rest, scores, strict=True):
                if values is not None:
                    found = sorted(found + [(a, 3, b) for (a, b), score in zip(own, values, strict=True) if score >= net.threshold])
                place = (lambda at: at) if body.isascii() else (lambda at, b=body: len(b[:at].decode("utf-8", "replace")))
                found = [(place(a), k, place(b)) for a, k, b in found]
                findings.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
                union: list[dict] = []
                for a, _, b in found:
                    if union and a <= union[-1]["end"]:
                        union[-1]["end"] = max(b, union[-1]["end"])
                    else:
                        union.append({"start": a, "end": b})
                masks.append(union)
            arrays = [held[c] for c in kept] + [pa.array(findings, kinds[0]), pa.array(masks, kinds[1])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "findings", "masks"])

    added = T.StructType.fromDDL(f"findings {FINDINGS}, masks {MASKS}")
    return rows.mapInArrow(find, T.StructType([*rows.schema, *added]))


def _run_scores(bodies: list[bytes], runs: list[list[tuple[int, int]]], net: CharNet | None) -> list:
    """Of each text, the scores of its runs or parts: the highest of a run's segments."""
    if net is None:
        return [None] * len(bodies)
    out, codes, sizes = [], [], []
    scored: list[np.ndarray] = []

    def flush() -> None:
        if codes:
            scored.append(net.scores(np.frombuffer(b"".join(codes), np.uint8).reshape(-1, WIDTH)))
            codes.clear()

    for body, own in zip(bodies, runs, strict=True):
        for start, end in own:
            pieces = windows_of(body, start, end)
            sizes.append(len(pieces))
            codes.extend(pieces)
            if len(codes) >= 4096:
                flush()
    flush()
    values = np.concatenate(scored) if scored else np.empty(0)
    tops = np.maximum.reduceat(values, np.cumsum([0, *sizes[:-1]])) if sizes else values
    at = 0
    for own in runs:
        out.append(tops[at : at + len(own)])
        at += len(own)
    return out


def redact(docs: DataFrame, net: CharNet | None, filler: str = "[secret]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``filler``; ``n_chars``, if there, follows.

    Documents without findings stay as they are; none goes. The findings are written beside the texts.
    """
    with small_batches(docs.sparkSession):
        found = cut_lineage(find_secrets(docs, net))
    text = replace_spans(F.col("text"), F.col("masks"), filler)
    new = {"text": text}
    if "n_chars" in docs.columns:
        length = replaced_length(F.col("text"), F.col("masks"), filler)
        length = length.cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.size("masks") > 0, length).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
