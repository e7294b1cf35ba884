"""Secret scans: base rules plus a character convolutional network over every candidate in its context.

Base rules (kinds assign, access, hex) give spans that always stay. Candidates of the network are all
runs of 12 or more of [A-Za-z0-9+/_.=-] of whatever make-up; only those that a base span covers whole are left out, as
nothing could be added. Each is read with its surroundings (24 characters before, 40 of it, 8 behind; characters
beyond ASCII count as ?), a longer one in overlapping windows of 40 over its whole length, by a small network in
numpy (long ones by a second, with its own threshold): character embedding, one convolution, maximum over places,
logistic output. It is trained on labelled findings (`labelled_findings` and `long_findings`, written out from
documented generators of secrets and of harmless strings, so the labels are synthetic), its output is calibrated by
Platt scaling on held-back findings, and the threshold is the largest at which recall on them is still `recall`; a
long finding counts by its best window. Added spans have the kind learned: short candidates whole, of longer ones the
windows at the threshold, widened to the next of / . = on both sides. A learned span may overlap base spans; masking
takes their union.

Nulls and edges: a null or empty text has no spans (hash of the empty string, empty list); a null doc_id and
repeated rows pass; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import release, small_batches

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
#: Both rules take maximal runs and then drop short ones; the bounded forms find the same spans.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
BEFORE, INSIDE, BEHIND = 24, 40, 8
WIDTH = BEFORE + INSIDE + BEHIND
STEP = 10


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base rules, sorted."""
    found = []
    if "=" in text or ":" in text:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """All runs but those within one base span."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    if not base:
        return found
    starts, ends = [s for s, _, _ in base], [*accumulate((e for _, _, e in base), max)]  # the farthest end so far
    inside = lambda a, b: (k := bisect_right(starts, a)) > 0 and ends[k - 1] >= b
    return [(a, b) for a, b in found if not inside(a, b)]


def window(text: str, a: int, b: int) -> bytes:
    """The candidate in its surroundings as WIDTH byte codes; other characters are ?, padding 0."""
    one = lambda s: s.encode("ascii", "replace")
    inside = one(text[a : min(b, a + INSIDE)])
    return one(text[max(0, a - BEFORE) : a]).rjust(BEFORE, b"\0") + inside.ljust(INSIDE, b"\0") + one(text[b : b + BEHIND]).ljust(BEHIND, b"\0")


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """The windows of a candidate: itself, or one of INSIDE characters every STEP and one at its end."""
    return [(a, b)] if b - a <= INSIDE else [(p, p + INSIDE) for p in [*range(a, b - INSIDE, STEP), b - INSIDE]]


def widened(text: str, a: int, b: int, fired: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted windows of the candidate (a, b) widened to / . = or its ends, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for p, q in fired:
        while p > a and text[p - 1] not in "/.=":
            p -= 1
        while q < b and text[q] not in "/.=":
            q += 1
        if out and p <= out[-1][1]:
            p, q = out[-1][0], max(q, out.pop()[1])
        out.append((p, q))
    return out


#: The commonest letter pairs of English, of which harmless words are made.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch be ma si om ur sc ge ei el la qu ue os do au ie em un da za bo ga wh bl".split()


def makers(rng: np.random.Generator) -> tuple:
    """Generators of a word, of secrets and of harmless strings."""
    pick = lambda alphabet, k: "".join([alphabet[i] for i in rng.integers(0, len(alphabet), k).tolist()])
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, int(rng.integers(2, 10)))
    natural = lambda least, most: pick(PAIRS, int(rng.integers(least, most)))
    full = low + up + dig
    secrets = [
        lambda: pick(full, int(rng.integers(20, 41))),
        lambda: pick(full + "+/", int(rng.integers(20, 41))) + "=" * int(rng.integers(0, 3)),
        lambda: pick(low, 2) + "_" + pick(low, 4) + "_" + pick(full, int(rng.integers(20, 37))),
        lambda: pick(low, 3) + "-" + pick(full, int(rng.integers(24, 41))),
        lambda: pick(up + dig, int(rng.integers(18, 33))),
        lambda: ".".join(pick(full + "_-", int(rng.integers(12, 20))) for _ in range(3)),
        lambda: pick("0123456789ABCDEF", int(rng.integers(24, 41))),
        lambda: pick(low, int(rng.integers(24, 41))),
        lambda: pick(up, int(rng.integers(24, 41))),
    ]
    harmless = [
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}",
        lambda: "-".join(word() for _ in range(3)) + f"-{rng.integers(1, 99)}",
        lambda: f"{word()}.{word()}{rng.integers(1, 99)}.com/{word()}",
        lambda: word() + word() + "_" + word() + str(rng.integers(0, 999)),
        lambda: word() + word() + word().title() + word().title(),
        lambda: f"v{rng.integers(0, 30)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}-{word()}{rng.integers(0, 9)}",
        lambda: f"{word()}.{word()}_{rng.integers(10, 9999)}",
        lambda: f"{pick(dig, 3)}-{pick(dig, 3)}-{pick(dig, 4)}-x{pick(dig, 3)}",
        lambda: word() * 2 + ".." + word().title() + "." + word(),
        lambda: natural(6, 9) + ("." if rng.random() < 0.2 else ""),
        lambda: natural(8, 16),
        lambda: natural(6, 12).title() + ("." if rng.random() < 0.2 else ""),
        lambda: natural(6, 10).upper(),
        lambda: natural(3, 5) + "-" + natural(3, 5) + ("-" + natural(2, 4) if rng.random() < 0.5 else ""),
        lambda: natural(2, 5) + "." + natural(4, 6).title(),
        lambda: natural(4, 8) + "." + str(rng.integers(10, 99)),
        lambda: ".".join(str(rng.integers(1, 256)) for _ in range(4)),
        lambda: pick(dig, int(rng.integers(12, 31))),
        lambda: pick("-=._", 1) * int(rng.integers(12, 60)),
        lambda: word() + str(rng.integers(0, 9)) + ".example.com",
    ]
    return word, secrets, harmless


def long_findings(n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and finding numbers of n runs of more than INSIDE characters: paths, every second with a secret
    at its end. Windows that hold only a part of a secret, below 16 characters, are left out."""
    rng = np.random.default_rng(seed)
    word, secrets, _ = makers(rng)
    number = lambda: str(rng.integers(0, 10**8)).zfill(8)
    parts = [word, word, word, lambda: word().title(), lambda: word() + str(rng.integers(0, 99)), lambda: "ABTUX"[int(rng.integers(5))] + number(), lambda: f"{word()}.com", lambda: f"v{rng.integers(1, 9)}"]
    rows, labels, of = [], [], []
    for i in range(n):
        joint, head = "/./-_"[int(rng.integers(5))], ""
        while len(head) < (rng.integers(12, 90) if i % 2 else rng.integers(INSIDE + 1, 120)):
            head += parts[int(rng.integers(len(parts)))]() + joint
        value = secrets[int(rng.integers(len(secrets)))]() if i % 2 else ""
        before = " ".join(word() for _ in range(5)) + " "
        text, a = before + head + value + " " + word() + " " + word(), len(before)
        b = a + len(head + value)
        for p, q in windows(a, b):
            held = max(0, min(q, b) - max(p, b - len(value)))
            if held == 0 or held >= 16:
                rows.append(window(text, p, q))
                labels.append(int(held > 0))
                of.append(i)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDTH), np.array(labels), np.array(of)


def labelled_findings(n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """n labelled windows: half are secrets of several make-ups, half harmless strings, in invented prose."""
    rng = np.random.default_rng(seed)
    word, secrets, harmless = makers(rng)
    hints = ["key ", "Authorization: Bearer ", "auth=", "pwd: ", "credential ", "", "", ""]
    rows, labels = [], np.zeros(n, int)
    for i in range(n):
        labels[i] = i % 2
        value = (secrets if labels[i] else harmless)[int(rng.integers(len(secrets) if labels[i] else len(harmless)))]()
        before = " ".join(word() for _ in range(5)) + " " + (hints[int(rng.integers(len(hints)))] if labels[i] or rng.random() < 0.2 else "")
        behind = f":{rng.integers(0, 60):02d}:{rng.integers(0, 60):02d}" if re.search(r"T\d\d$", value) and not labels[i] else ""
        rows.append(window(before + value + behind + " " + word() + " " + word(), len(before), len(before) + len(value)))
    return np.frombuffer(b"".join(rows), np.uint8).reshape(n, WIDTH), labels


@dataclass
class Network:
    """Byte embedding (128 x E), convolution of 5 places (5E x H), maximum, logistic output with Platt scaling."""

    e: np.ndarray
    c: np.ndarray
    cb: np.ndarray
    o: np.ndarray
    ob: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    long: Network | None = None

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        emb = self.e[x]
        wide = np.concatenate([emb[:, i : x.shape[1] - 4 + i] for i in range(5)], axis=2)
        return wide, wide @ self.c + self.cb

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [np.maximum(self.hidden(x[lo : lo + 128])[1].max(1), 0) @ self.o + self.ob for lo in range(0, len(x), 128)]
        return np.concatenate(out) if out else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))


def train(n: int = 7000, recall: float = 0.98, epochs: int = 6, seed: int = 11) -> Network:
    """The network of n findings, and as its `long` one that has also learnt windows of long findings and has its
    threshold from these."""
    x, y = labelled_findings(n)
    net = fitted(x, y, np.arange(n), 0, recall, epochs, seed)
    more, labels, of = long_findings(n // 8)
    net.long = fitted(np.concatenate([x, more]), np.concatenate([y, labels]), np.concatenate([np.arange(n), n + of]), n, recall, epochs, seed)
    return net


def fitted(x: np.ndarray, y: np.ndarray, of: np.ndarray, first_of: int, recall: float, epochs: int, seed: int) -> Network:
    """Fit on four fifths of the findings (of: their numbers; Adam, fixed order), calibrate on the rest and set the
    threshold on those of the rest from number first_of on."""
    part = of % 10 < 8
    rng = np.random.default_rng(seed)
    dim, hid = 8, 32
    net = Network(*(v.astype(np.float32) for v in (rng.normal(0, 0.3, (128, dim)), rng.normal(0, 0.2, (5 * dim, hid)), np.zeros(hid), rng.normal(0, 0.2, hid))), 0.0)
    names = ("e", "c", "cb", "o")
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    step = 0
    fit = np.flatnonzero(part)
    for _ in range(epochs):
        rng.shuffle(fit)
        for lo in range(0, len(fit), 64):
            b = x[fit[lo : lo + 64]]
            wide, h = net.hidden(b)
            at = h.argmax(1)
            top = np.take_along_axis(h, at[:, None, :], 1)[:, 0]
            act = np.maximum(top, 0)
            z = act @ net.o + net.ob
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[fit[lo : lo + 64]]) / len(b)).astype(np.float32)
            dh = np.where(top > 0, d[:, None] * net.o, 0)
            rows = np.arange(len(b))[:, None]
            chosen = wide[rows, at]
            grad = {"o": act.T @ d, "c": np.einsum("bhe,bh->eh", chosen, dh), "cb": dh.sum(0)}
            back = dh[:, :, None] * net.c.T[None]
            ge = np.zeros_like(net.e)
            for i in range(5):
                np.add.at(ge, b[rows, at + i], back[:, :, i * dim : (i + 1) * dim])
            grad["e"] = ge
            net.ob -= 0.02 * float(d.sum())
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                setattr(net, k, getattr(net, k) - np.float32(0.01) * (first[k] / np.float32(1 - 0.9**step)) / (np.sqrt(second[k] / np.float32(1 - 0.999**step)) + np.float32(1e-8)))
    z, t = net.logits(x[~part]), y[~part]
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30)))
        net.scale -= 0.1 * float(((p - t) * z).mean())
        net.shift -= 0.1 * float((p - t).mean())
    held = ~part & (y == 1) & (of >= first_of)
    p, of = net.probability(x[held]), of[held]
    p = np.sort([p[of == i].max() for i in np.unique(of)])
    net.threshold = float(p[int((1 - recall) * len(p))])
    return net


def all_spans(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """Base and learned spans of each text, sorted by start, then kind."""
    spans = [base_spans(t) for t in texts]
    found = [(i, a, b, p, q) for i, t in enumerate(texts) for a, b in candidates(t, spans[i]) for p, q in windows(a, b)]
    if found:
        x = np.frombuffer(b"".join(window(texts[i], p, q) for i, _, _, p, q in found), np.uint8).reshape(-1, WIDTH)
        fired: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        long, fires = np.array([b - a > INSIDE for _, a, b, _, _ in found]), np.zeros(len(found), bool)
        for own, at in ((net, ~long), (net.long or net, long)):
            fires[at] = own.probability(np.minimum(x[at], 127)) >= own.threshold
        for (i, a, b, p, q), fire in zip(found, fires.tolist()):
            if fire:
                fired.setdefault((i, a, b), []).append((p, q))
        for (i, a, b), places in fired.items():
            spans[i] += [(p, 3, q) for p, q in widened(texts[i], a, b, places)]
    return [sorted(s) for s in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans. Narrow: no shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                spans = all_spans([t or "" for t in rows.column(1).to_pylist()], shared.value)
                base = [[s for s in x if s[1] < 3] for x in spans]
                count = lambda k: pa.array([sum(s[1] == k for s in x) for x in base], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), count(0), count(1), count(2), pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(x) for x in spans])],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, net: Network | None = None, mask: str = "[secret]") -> DataFrame:
    """docs with every span of text replaced by mask (overlapping spans as one) and n_chars, if there is such
    a column, recounted; other columns as they are. A null text stays null."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net or train())
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at = columns.index("text")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = []
            for t, spans in zip(texts, all_spans([t or "" for t in texts], shared.value)):
                parts, end = [], 0
                for a, _, b in spans:
                    if a >= end:
                        parts += [t[end:a], mask]
                    end = max(end, b)
                out.append("".join([*parts, t[end:]]) if spans else t)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.string()))

    found = docs.mapInArrow(run, docs.schema)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else found
