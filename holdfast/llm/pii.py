"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Patterns find e-mail addresses, IP addresses, card and phone numbers in the whole text. The random
field then labels the words that hold a digit or an @ (no other word can be part of such data, so the
chain falls into pieces between them). Neighbouring words share a potential; so do, however far apart,
words that repeat the same core and words of the same shape, each with its last occurrence before.
Loopy message passing over these chains gives every word a label that fits the whole document. Runs
of words labelled alike become spans where no pattern has one; spans of the patterns always stay.

Training is piecewise, from the patterns' own labels in a sample: a multinomial logistic model for the
words, and log ratios of label pairs for neighbours, repeats and shapes. The sample is taken by a hash of
id and text, and comes to the driver as counts: how often each set of features has each label, and how often
two labels are linked. So it does not depend on how rows are split over tasks. Word features are taken
from the core of a word, without the marks around it, so words that marks have torn apart look like
those that the patterns know.

Defined cases: null text is empty and has no spans; spans count code points; very long texts stay
whole, and patterns take linear time; repeated rows are labelled alike; an empty table trains nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import slices, small_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Documents with digits or @ that training reads, about, and different sets of features that it uses at most, by their hash.
MAX_TRAIN, MAX_WORDS = 5_000, 50_000
#: Least posterior of a label for a word to be part of an added span.
SURE = 0.95
ROUNDS = 8
BITS = 10

_HINT = re.compile(r"[0-9@]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a failing start in a run of digits fails at every other place of the run, so only its first is tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CORE = re.compile(r"[+(]*[A-Za-z0-9À-￿](?:.*[A-Za-z0-9À-￿])?\)?", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ to both sides."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            found.append((start, tail.end()))
            done = tail.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind as listed, then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


class Words:
    """The words of a text that may be personal data, their features and their links."""

    def __init__(self, text: str):
        self.start, self.end, self.cores = [], [], []
        shapes, near = [], []
        last, gap = -1, False
        for m in re.finditer(r"\S+", text):
            word = m[0]
            if _HINT.search(word):
                core = _CORE.search(word)
                if core:
                    near.append(gap is False and last >= 0)
                    self.start.append(m.start() + core.start())
                    self.end.append(m.start() + core.end())
                    self.cores.append(core[0])
                    shapes.append(self.shape(core[0]))
                    last, gap = len(shapes) - 1, False
                    continue
            if any(c.isalnum() for c in word):
                gap = True
        n = len(shapes)
        self.chain = [(i - 1, i) for i in range(1, n) if near[i]]
        self.repeats, self.similar = self.skips(self.cores), self.skips(shapes)
        prev, nxt = [""] * n, [""] * n
        for i, j in self.chain:
            prev[j], nxt[i] = shapes[i], shapes[j]
        self.features = [self.hashed(c, s, p, x) for c, s, p, x in zip(self.cores, shapes, prev, nxt, strict=True)]

    @staticmethod
    def shape(core: str) -> str:
        runs = re.findall(r"[0-9]+|[^\W0-9_]+|.", core[:200], re.S)
        return "".join(f"9{min(len(r), 20)}" if r[0].isdigit() else "a" if r[0].isalpha() else r for r in runs)

    @staticmethod
    def skips(values: list[str]) -> list[tuple[int, int]]:
        seen: dict[str, int] = {}
        out = []
        for i, v in enumerate(values):
            if v in seen:
                out.append((seen[v], i))
            seen[v] = i
        return out

    @staticmethod
    def hashed(core: str, shape: str, prev: str, nxt: str) -> list[int]:
        digits = re.sub(r"\D", "", core)
        names = [f"s{shape}", f"p{prev}|{shape[:3]}", f"n{nxt}|{shape[:3]}", f"d{min(len(digits), 20)}", f"l{16 <= len(digits) <= 19 and luhn(digits)}", f"@{core.count('@')}{'.' in core.rpartition('@')[2]}", f".{core.count('.')}", f"a{core[:1]}", f"z{core[-1:].isdigit()}", f"c{re.sub('[0-9a-zA-Z]', '', core)[:6]}"]
        return [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=4).digest(), "little") >> (32 - BITS) for x in names]


def labels(words: Words, spans: list[tuple[str, int, int]]) -> list[int]:
    """0, or 1 + the kind of the pattern's span that a word touches."""
    out = [0] * len(words.start)
    for kind, a, b in spans:
        for i in range(bisect_right(words.end, a), bisect_left(words.start, b)):
            out[i] = 1 + KINDS.index(kind)
    return out


def _ratios(counts: np.ndarray) -> list[list[float]]:
    counts = counts + 0.5
    return np.clip(np.log(counts * counts.sum() / (counts.sum(1)[:, None] * counts.sum(0)[None, :])), -3, 3).tolist()


def fit(keys: np.ndarray, labelled: np.ndarray, linked: np.ndarray, steps: int = 300) -> dict | None:
    """Rows of features, how often each has each label, and label pairs of neighbours, repeats and shapes -> weights and pair potentials."""
    if not len(keys):
        return None
    k = 1 + len(KINDS)
    sums = np.sqrt(labelled.sum(1, keepdims=True)) * labelled / labelled.sum(1, keepdims=True)
    weights, moment, square = np.zeros((1 << BITS, k)), 0.0, 0.0
    flat, width = keys.ravel(), keys.shape[1]
    for t in range(1, steps + 1):
        score = weights[keys].sum(1) + weights[0]
        odds = np.exp(score - score.max(1, keepdims=True))
        odds /= odds.sum(1, keepdims=True)
        error = odds * sums.sum(1, keepdims=True) - sums
        grad = np.stack([np.bincount(flat, np.repeat(error[:, i], width), 1 << BITS) for i in range(k)], axis=1)
        grad[0] += error.sum(0)
        grad = grad / sums.sum() + 1e-4 * weights
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        weights -= 0.1 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return {"weights": weights, "pairs": [np.array(_ratios(p)) for p in linked]}


def posteriors(words: Words, model: dict) -> np.ndarray:
    """Label probabilities of each word, by loopy sum-product over chain, repeats and shapes."""
    unary = np.array([model["weights"][f].sum(0) + model["weights"][0] for f in words.features])
    links = [(i, j, kind) for kind, pairs in enumerate((words.chain, words.repeats, words.similar)) for i, j in pairs]
    unary = unary - np.logaddexp.reduce(unary, axis=1, keepdims=True)
    belief = unary
    if links:
        a, b, kind = (np.array(c) for c in zip(*links, strict=True))
        forth = np.array(model["pairs"])[kind]
        # repeats tell the same again and again: a similar shape counts for less
        forth = forth * np.array([1.0, 1.0, 0.3])[kind][:, None, None]
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        table_ = np.concatenate([forth, forth.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        sent = np.zeros((len(src), unary.shape[1]))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst, sent)
            new = np.logaddexp.reduce((belief[src] - sent[back])[:, :, None] + table_, axis=1)
            sent = 0.5 * sent + 0.5 * (new - np.logaddexp.reduce(new, axis=1, keepdims=True))
        belief = unary.copy()
        np.add.at(belief, dst, sent)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def _united(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans' union, each in rising order: what starts before an end and ends behind a start overlaps."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def find(text: str | None, model: dict | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the patterns, and those that the random field adds."""
    if not text or not _HINT.search(text):
        return [], []
    base = base_spans(text)
    if model is None:
        return base, []
    words = Words(text)
    if not words.start:
        return base, []
    odds = posteriors(words, model)
    best = odds.argmax(1)
    best[odds.max(1) < SURE] = 0
    held = np.array(labels(words, base)) > 0
    joins, added, at = set(words.chain), [], 0
    starts, ends = _united(base)
    while at < len(best):
        end = at + 1
        if best[at]:
            while end < len(best) and best[end] == best[at] and (end - 1, end) in joins and held[end] == held[at]:
                end += 1
            kind = KINDS[best[at] - 1]
            # one address to a word; numbers may be torn over several
            parts = [(i, i + 1) for i in range(at, end)] if kind in ("email", "ip") else [(at, end)]
            for i, j in parts:
                digits = sum(c.isdigit() for w in words.cores[i:j] for c in w)
                fits = {"email": 0 < words.cores[i].find("@"), "ip": True, "card": digits >= 12, "phone": 7 <= digits <= 15}[kind]
                if not held[i] and fits and bisect_left(starts, words.end[j - 1]) == bisect_right(ends, words.start[i]):
                    added.append((kind, words.start[i], words.end[j - 1]))
        at = end
    return base, added


def train(docs: DataFrame, max_docs: int = MAX_TRAIN, max_words: int = MAX_WORDS) -> dict | None:
    """A model from a sample of docs (doc_id, text). The driver gets at most `max_words` rows of counts, and the label pairs."""
    docs = small_batches(docs).select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    total = docs.count()
    if total > max_docs:
        docs = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)) < int(max_docs / total * 1_000_000_000))
    k = 1 + len(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linked = np.zeros((3, k, k), np.int64)

        def out(rows: dict[tuple[int, ...], list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(x) for x in rows], pa.list_(pa.int32())), pa.array(list(rows.values()), pa.list_(pa.int64()))], ["features", "counts"])

        for batch in slices(batches, "text"):
            rows: dict[tuple[int, ...], list[int]] = {}
            for text in batch.column("text").to_pylist():
                words = Words(text)
                own = labels(words, base_spans(text))
                for feature, label in zip(words.features, own, strict=True):
                    rows.setdefault(tuple(feature), [0] * k)[label] += 1
                for at, pairs in enumerate((words.chain, words.repeats, words.similar)):
                    for i, j in pairs:
                        linked[at, own[i], own[j]] += 1
            yield out(rows)
        yield out({(-1 - at,): linked[at].ravel().tolist() for at in range(3)})

    found = docs.mapInArrow(run, "features array<int>, counts array<long>").select("features", F.posexplode("counts").alias("label", "n"))
    sums = found.groupBy("features", "label").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("features").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"))  # a few labels to a row
    rows = rows.withColumn("own", F.size("features") > 1).orderBy("own", F.xxhash64("features"), "features").limit(3 + max_words).collect()
    linked = np.zeros((3, k, k))
    for r in rows:
        if not r["own"]:
            linked[-1 - r["features"][0]] = np.array([r["counts"][i] for i in range(k * k)]).reshape(k, k)
    own = sorted((r["features"], r["counts"]) for r in rows if r["own"]) if rows else []
    return fit(np.array([x for x, _ in own], np.int64), np.array([[c[i] for i in range(k)] for _, c in own], np.float64), linked)


def annotate(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs (doc_id, text) -> counts of the patterns, base_sha256, spans, and n_added."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                base, added = find(text, sent.value)
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names)

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with <kind> for each span; overlapping spans are masked as one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """Pipeline stage: all rows and columns; personal data in text is masked, and n_chars follows."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t if t is None else masked(t, [s for part in find(t, sent.value) for s in part]) for t in batch.column("text").to_pylist()]
            columns = dict(zip(names, batch.columns, strict=True)) | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if t is None else len(t) for n, t in zip(columns["n_chars"].to_pylist(), texts, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return small_batches(docs).mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return annotate(docs, train(docs))
