"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, text_of
from .shingles import mix
from .token_ids import chunks

ORDER = 4
#: Labelled rows of each language that the models and their calibration are fitted on, about; whole texts.
SAMPLE = 2000
#: More languages than this in the labels are an error rather than a model that no longer fits a worker's memory.
LANGUAGES = 256
#: One in so many rows of the sample calibrates instead of being counted, if its text has so many code points at most: those
#: texts meet on the driver.
CALIBRATE, LONGEST = 4, 20_000
#: Code points that a worker scores at once, about.
AT_ONCE = 250_000
#: A prediction less sure than this is rejected; so is a text whose cross-entropy is beyond all but one in a thousand
#: calibration texts by more than SLACK nats a character.
SURE, SLACK = 0.5, 1.0
PAD = 1
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
_A = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point, whether it is a letter (Unicode category L)."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, lower-cased, each run of others than letters one space, ORDER - 1 pads before each text.

    Returns them, where each text begins (one more place than texts), and each text's number of letters.
    """
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    head = np.full(ORDER - 1, PAD, np.uint32)
    joined = np.concatenate([x for p in points for x in (head, p)]) if points else np.empty(0, np.uint32)
    sizes = np.array([len(p) + ORDER - 1 for p in points], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    pads = np.zeros(len(joined), bool)
    for k in range(ORDER - 1):
        pads[starts[:-1] + k] = True
    letter = is_letter()[joined]
    flat = np.where(letter | pads, joined, 32).astype(np.uint32)
    keep = flat != 32
    keep[1:] |= flat[:-1] != 32
    at = np.r_[0, np.cumsum(keep)]
    counted = np.r_[0, np.cumsum(letter)]
    return flat[keep], at[starts], counted[starts[1:]] - counted[starts[:-1]]


def gram_hashes(points: np.ndarray, order: int, places: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the grams of that order that end at each place, or at those given; places below order - 1 are of no use."""
    places = np.arange(len(points)) if places is None else places
    out = np.zeros(len(places), np.uint64)
    for back in range(order - 1, -1, -1):
        out *= _A
        out += points[places - back]
        out += np.uint64(1)
    return mix(out + np.uint64(order))


@dataclass
class Model:
    """By order: sorted gram hashes and each language's log-probability of the last character; sorted context hashes and
    each language's log-weight of the shorter gram. floor: each language's log-probability of a character none has."""

    languages: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: np.ndarray
    slope: float = 1.0
    base: float = 0.0
    most: float = math.inf

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return at, table[at] == wanted

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a character, by text and language, and the texts' letters."""
        points, starts, letters = characters(texts)
        if not len(points):
            return np.zeros((len(texts), len(self.languages))), letters
        logs = self._logs(points)
        for k in range(ORDER - 1):
            logs[starts[:-1] + k] = 0
        sums = np.add.reduceat(logs, starts[:-1], axis=0)
        return -sums / np.maximum(np.diff(starts) - (ORDER - 1), 1)[:, None], letters

    def _logs(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros((len(points), len(self.languages)), np.float32)
        left = np.arange(len(points))
        for order in range(ORDER, 0, -1):
            at, there = self._find(self.grams[order], gram_hashes(points, order, left))
            out[left[there]] += self.logs[order][at[there]]
            left = left[~there]
            if not len(left):
                return out
            if order > 1:
                before = np.maximum(left - 1, 0)
                at, there = self._find(self.contexts[order], gram_hashes(points, order - 1, before))
                out[left[there]] += self.weights[order][at[there]]
        out[left] += self.floor
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, calibrated score, cross-entropy and rejection of each text; und where there is no letter."""
        entropy, letters = self.entropies(texts)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(texts)), best]
        score = self.sure(self.evidence(entropy, letters))
        none = letters == 0
        score[none] = 0
        names = ["und" if n else self.languages[b] for b, n in zip(best.tolist(), none.tolist(), strict=True)]
        return names, score, np.where(none, 0.0, least), none | (score < SURE) | (least > self.most)

    @staticmethod
    def evidence(entropy: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """log(1 + letters * gap) for the gap between the two lowest cross-entropies."""
        if entropy.shape[1] < 2:
            return np.log1p(letters.astype(float))
        low = np.partition(entropy, 1, axis=1)
        return np.log1p(letters * (low[:, 1] - low[:, 0]))

    def sure(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * evidence, -30, 30)))

    def calibrate(self, texts: list[str], truth: list[str]) -> None:
        """Logistic fit of being right on the evidence, with a prior of slope and base near 1 and 0, by Newton steps."""
        rows = [self.entropies(some) for some in chunks(texts)]
        if not rows:
            return
        entropy, letters = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        has = letters > 0
        entropy, letters = entropy[has], letters[has]
        if not len(entropy):
            return
        code = {name: i for i, name in enumerate(self.languages)}
        right = entropy.argmin(axis=1) == np.array([code[t] for t, h in zip(truth, has, strict=True) if h])
        x = np.c_[np.ones(len(right)), self.evidence(entropy, letters)]
        theta = np.array([0.0, 1.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            slope = x.T @ (right - p) - (theta - [0.0, 1.0])
            bend = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
            theta += np.linalg.solve(bend, slope)
        self.base, self.slope = float(theta[0]), max(float(theta[1]), 1e-3)
        self.most = float(np.quantile(entropy.min(axis=1), 0.999)) + SLACK


def _points(gram: str) -> np.ndarray:
    return np.frombuffer(gram.encode("utf-32-le", "surrogatepass"), np.uint32)


def build(counts: dict[str, dict[str, int]]) -> Model:
    """The model from each language's counts of grams of ORDER characters.

    Shorter grams count by how many characters precede them. The discount of an order is n1 / (n1 + 2 n2). Every gram
    of any language gets every language's interpolated probability, so that one look-up serves all.
    """
    languages = sorted(counts)
    by_order: dict[int, list[dict[str, int]]] = {ORDER: [dict(counts[x]) for x in languages]}
    for k in range(ORDER - 1, 0, -1):
        by_order[k] = [dict(Counter(g[1:] for g in longer)) for longer in by_order[k + 1]]
    alphabet = len({g for c in by_order[1] for g in c}) + 1
    model = Model(languages, [None] * (ORDER + 1), [None] * (ORDER + 1), [None] * (ORDER + 1), [None] * (ORDER + 1), np.zeros(len(languages), np.float32))
    shorter: dict[str, np.ndarray] = {}
    for k in range(1, ORDER + 1):
        union = sorted({g for c in by_order[k] for g in c})
        probability = {g: np.empty(len(languages)) for g in union}
        weights: dict[str, np.ndarray] = {}
        for i, c in enumerate(by_order[k]):
            ones, twos = (sum(v == n for v in c.values()) for n in (1, 2))
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            total, kinds = defaultdict(int), defaultdict(int)
            for g, n in c.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            spare = {h: discount * kinds[h] / total[h] for h in total}
            for h, w in spare.items():
                weights.setdefault(h, np.ones(len(languages)))[i] = w
            for g, row in probability.items():
                h = g[:-1]
                lower = shorter[g[1:]][i] if k > 1 else 1 / alphabet
                row[i] = max(c.get(g, 0) - discount, 0) / total[h] + spare[h] * lower if h in total else lower
        for name, found in (("grams", probability), ("contexts", weights)):
            keys = list(found)
            size = k if name == "grams" else k - 1
            if keys and size:
                text = _points("".join(keys))
                hashed = gram_hashes(text, size)[size - 1 :: size]
            else:
                hashed = np.zeros(len(keys), np.uint64)
            order = np.argsort(hashed)
            rows = np.log(np.array([found[g] for g in keys]).reshape(len(keys), len(languages))).astype(np.float32)
            getattr(model, name)[k] = hashed[order]
            getattr(model, "logs" if name == "grams" else "weights")[k] = rows[order]
        if k == 1:
            model.floor = np.log(weights[""] / alphabet).astype(np.float32)
        shorter = probability
    return model


def _count(found: Iterator) -> Iterator:
    """Rows (lang, text, calibrates) to counts of grams by language within the task; calibration rows pass as they are."""
    import pyarrow as pa

    counts: dict[str, Counter] = defaultdict(Counter)
    kept: list[tuple[str, str]] = []
    for batch in found:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        kept += [(lang, text) for lang, text, aside in rows if aside]
        for lang, text, aside in rows:
            if not aside:
                points, _, _ = characters([text])
                held = points.tobytes().decode("utf-32-le", "surrogatepass")
                counts[lang].update(held[i : i + ORDER] for i in range(len(held) - ORDER + 1))
    for lang, found_in in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found_in)), pa.array(list(found_in)), pa.array(list(found_in.values()), pa.int64())], ["lang", "gram", "n"])
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept]), pa.array([x[1] for x in kept]), pa.array([None] * len(kept), pa.int64())], ["lang", "gram", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The calibrated model of labelled docs (doc_id, text, lang), from about `sample` rows of each language.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out, and rows without id, lang or text left out. Rows are
    taken by the hash of their id, all of a language that has no more than `sample`, so the choice doesn't depend on how
    the table is split; of those, one in CALIBRATE calibrates. None if nothing can be learned.
    """
    key, order = F.crc32(F.col("doc_id").cast("string")), F.xxhash64("doc_id")
    learned = docs.where((key % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", order.alias("_h"), ((key % (5 * CALIBRATE) < 5) & (F.char_length("text") <= LONGEST)).alias("aside"))
    sizes = learned.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()
    if not sizes:
        return None
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # hashes are spread evenly over 64 bits, so this part of them has about `sample` rows
    part = {row["lang"]: min(1.0, sample / row["n"]) for row in sizes}
    cut = F.create_map(*[F.lit(x) for lang, p in part.items() for x in (lang, min(2**63 - 1, -(2**63) + int(p * 2**64)))])
    taken = learned.where(F.col("_h") <= F.try_element_at(cut, F.col("lang"))).select("lang", "text", "aside")
    rows = taken.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram", F.col("n").isNull().alias("aside")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for row in rows:
        if not row["aside"]:
            counts[row["lang"]][row["gram"]] = row["n"]
    if not counts:  # so few rows that all are set aside: count them instead
        for row in rows:
            held = characters([row["gram"]])[0].tobytes().decode("utf-32-le", "surrogatepass")
            counts[row["lang"]] = dict(Counter(held[i : i + ORDER] for i in range(len(held) - ORDER + 1)) + Counter(counts[row["lang"]]))
    counts = {lang: c for lang, c in counts.items() if c}
    if not counts:
        return None
    model = build(counts)
    aside = [row for row in rows if row["aside"] and row["lang"] in counts for _ in range(row["rows"])]
    model.calibrate([row["gram"] for row in aside], [row["lang"] for row in aside])
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    Only the text is read. Text that is null or without a letter is und, with score 0, and rejected; without a model all
    is. A null doc_id is not held out. Long texts are scored whole, in arrays of bounded size.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE and LANGUAGES

    def judge(found: Iterator) -> Iterator:
        import pyarrow as pa

        model = held.value
        for batch in found:
            texts = batch.column(2).to_pylist()
            parts = [model.predict(some) for some in chunks(texts, AT_ONCE)] if model else [(["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool))]
            names = [x for p in parts for x in p[0]]
            rest = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t) for i, t in ((1, float), (2, float), (3, bool))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), *map(pa.array, rest)], [x.split()[0] for x in SCHEMA.split(", ")])

    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    rows = columns_of(docs, ["doc_id", "text"], "language identification").select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), text_of("text").alias("text"))
    return rows.mapInArrow(judge, SCHEMA)


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`identify` with the model that `fit` learns from docs (doc_id, text, lang) themselves."""
    columns_of(docs, ["doc_id", "text", "lang"], "language identification")
    return identify(docs, fit(docs, sample))


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that `identify` rejects, all columns as they were. Rows are judged one by one, in place.

    If no language can be learned, for want of labels, nothing can be rejected, and all rows stay.
    """
    model = fit(docs, sample)
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def keep(found: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in found:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            kept = [not r for some in chunks(texts, AT_ONCE) for r in held.value.predict(some)[3].tolist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, schema)
