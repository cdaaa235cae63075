"""Personal data: base patterns with checks, and boosted candidates, in DataFrame expressions only."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .arrays import let, let_sql, piece, prefix_sql, ranks, segments, tops
from .common import columns_of, text_of

KINDS = ("email", "ip", "card", "phone")
# The base patterns, each put so that matching takes linear time and no recursion: a run is entered at its first
# character or where the last match ended (\G), and repeats never give back what they took, which the classes allow.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
# High-recall generators of further candidates.
MORE = {
    "email": r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[a-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[a-z0-9-]++){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}+(?:[\x20.-]?[0-9]{2,7}+){2,4}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.,+/_-])(?:\(?[0-9]{2,5}+(?:[\x20)(./-]{1,2}+[0-9]{2,5}+){1,4}+|0[0-9]{8,11}+)(?![0-9A-Za-z])",
}
# Further ones, each searched by itself so that none takes characters from another: shortened and sentence-ending IPv6;
# numbers with a group of six or more digits after an area code, after several groups, or first; numbers right after a
# word's full stop.
_HEX, _PART = "[0-9A-Fa-f]{1,4}+", r"[\x20)(./-]{1,2}+"
_AHEAD, _BEHIND = r"(?<![0-9A-Za-z,+/_-])(?<![^\p{L}]\.)\(?", r"(?:-[0-9]{1,5}+)?+(?![0-9A-Za-z])"
# Spelled-out addresses end in one of these.
DOMAIN = r"(?i)[^a-z](?:com|org|net|edu|gov|info|biz|io|co|eu|de|fr|es|it|nl|ch|at|uk|us|ca|au|jp|cn|in|br|ru|pl|se)$"
FURTHER = {
    "email": (r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20at\x20[a-z0-9-]++(?:\x20dot\x20[a-z0-9-]++){1,4}+(?![a-z0-9@])",),
    "ip": (
        rf"(?<![0-9A-Za-z:.])(?=:*+[0-9A-Fa-f])(?=(?:[0-9A-Fa-f]{{0,4}}+:){{2,8}}+)(?:(?:{_HEX}:){{7}}+{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}}+)?+::(?:{_HEX}(?::{_HEX}){{0,6}}+)?+)(?![0-9A-Za-z:]|\.[0-9])",
    ),
    "phone": (
        rf"{_AHEAD}[0-9]{{2,5}}+{_PART}[0-9]{{6,10}}+{_BEHIND}",
        rf"{_AHEAD}[0-9]{{2,5}}+(?:{_PART}[0-9]{{2,5}}+(?![0-9])){{1,3}}+{_PART}[0-9]{{6,10}}+{_BEHIND}",
        rf"{_AHEAD}0[0-9]{{5,9}}+(?:{_PART}[0-9]{{2,5}}+(?![0-9])){{1,3}}+(?![0-9A-Za-z])",
        MORE["phone"].replace("(?<![0-9A-Za-z.,+/_-])", r"(?<=\p{L}\.)", 1),
    ),
}
#: The most colons of an address.
COLONS = 8
MORE_NEEDS = {"email": r"(?i)[\[({]at[\])}]|\x20dot\x20", "ip": "[0-9A-Fa-f]::?[0-9A-Fa-f]|::[0-9A-Fa-f]|[0-9A-Fa-f]::", "card": "[0-9]{4}", "phone": "[0-9]{2}"}
DIGITS = {"email": (0, 10**6), "ip": (0, 40), "card": (13, 19), "phone": (7, 15)}
#: A kind's candidates are redacted from the least calibrated probability on, between these two, from which on so large a
#: part of its candidates that weren't fitted on is personal data.
LEAST, MOST, PRECISION = 0.7, 0.9, 0.98
#: Code points before a candidate that its features see.
CONTEXT = 24
CUES = {
    "cue_phone": r"(?:tel|phone|call|mobile|cell|fax|whatsapp|sms|reach|dial|kontakt|t[ée]l[ée]phone|llame)[^\n]{0,12}$",
    "cue_card": r"(?:card|visa|master|amex|credit|debit|payment|iban|karte|carte|tarjeta)[^\n]{0,12}$",
    "cue_mail": r"(?:mail|contact|write|reach|address)[^\n]{0,12}$",
    "cue_other": r"(?:order|invoice|isbn|issn|version|ver|ref|serial|sku|ticket|track|page|pages|pp|date|year|lines?|no|nr|id|sum|total|rev|build|code|doi|score|table)[^a-z\n]{0,6}$",
}
NAMES = [*(f"is_{k}" for k in KINDS), "chars", "digits", "groups", "paren", "dots", "dashes", "spaces", "slashes", "colons", "zero", "luhn", "year", *CUES, "left_letter", "right_letter", "domain"]
SPAN = "array<struct<start:int,stop:int,m:string>>"
SPAN_AROUND = "array<struct<start:int,stop:int,m:string,left:string,right:string>>"
#: Made texts that the trees are fitted on.
MADE = 1600


def _found(pattern: str, needs: str, around: bool = False) -> Column:
    """Leftmost non-overlapping matches in the column text with their places in code points: the gaps between them give the
    places. Put as SQL, which is parsed at once.

    With `around` also left, the CONTEXT code points before each, and right, the one after it, which are read from the gaps
    and matches beside it, so that no match reads the text from its beginning.
    """
    # matches have two code points at least, so that many of them fill the context
    some = f"transform(sequence(greatest(i - {CONTEXT // 2}, 0), i), j -> concat(right(get(s.gaps, j), {CONTEXT}), if(j < i, right(get(s.hits, j), {CONTEXT}), '')))"
    left = f"if(char_length(get(s.gaps, i)) >= {CONTEXT}, right(get(s.gaps, i), {CONTEXT}), right(array_join({some}, ''), {CONTEXT})) AS left"
    right = "left(concat(left(get(s.gaps, i + 1), 1), left(coalesce(get(s.hits, i + 1), ''), 1)), 1) AS right"
    start = "get(before, i) + char_length(get(s.gaps, i))"
    hit = f"struct({start} AS start, {start} + char_length(h) AS stop, h AS m{f', {left}, {right}' if around else ''})"
    lengths = "transform(s.hits, (h, i) -> char_length(get(s.gaps, i)) + char_length(h))"
    none = f"cast(array() AS {SPAN_AROUND if around else SPAN})"
    placed = let_sql(prefix_sql(lengths, "{a} + {x}"), "before", f"transform(s.hits, (h, i) -> {hit})")
    both = f"struct(regexp_extract_all(text, r'{pattern}', 0) AS hits, split(text, r'{pattern}', -1) AS gaps)"
    has = "contains(text, '@')" if needs == "@" else f"text RLIKE r'{needs}'"
    return F.expr(f"if({has}, {let_sql(both, 's', f'if(size(s.hits) = 0, {none}, {placed})')}, {none})")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, 1).cast("int")  # type: ignore[arg-type]
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda a, i: a + worth(i))
    return F.when(F.char_length(digits) > 0, total % 10 == 0).otherwise(F.lit(False))


def _passes(kind: str, m: Column) -> Column:
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.try_cast("double") <= 255)
    size = F.char_length(_digits(m))
    if kind == "card":
        return F.when(size.between(13, 19), luhn(_digits(m))).otherwise(F.lit(False))
    return size.between(9, 15)


def _features(kind: str, span: Column) -> dict[str, Column]:
    m = span["m"]
    digits = _digits(m)
    left, right = F.lower(span["left"]), span["right"]
    count = lambda chars: F.char_length(m) - F.char_length(F.translate(m, chars, ""))
    flag = lambda c: c.cast("int")
    return {
        **{f"is_{k}": F.lit(int(k == kind)) for k in KINDS},
        "chars": F.char_length(m),
        "digits": F.char_length(digits),
        "groups": F.size(F.split(m, "[^0-9]+")),
        "paren": count("()[]"),
        "dots": count("."),
        "dashes": count("-"),
        "spaces": count(" "),
        "slashes": count("/"),
        "colons": count(":"),
        "zero": flag(digits.startswith("0")),
        "luhn": flag(luhn(digits)) if kind == "card" else F.lit(0),
        "year": flag(m.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")),
        **{name: flag(left.rlike(cue)) for name, cue in CUES.items()},
        "left_letter": flag(left.rlike(r"[\p{L}#$€£=%][^\p{L}0-9]?$")),
        "right_letter": flag(right.rlike(r"[\p{L}%€$]")),
        "domain": flag(m.rlike(DOMAIN)) if kind == "email" else F.lit(0),
    }


def _candidates(kind: str) -> Column:
    low, high = DIGITS[kind]
    each = F.array_sort(F.concat(*[_found(p, MORE_NEEDS[kind], around=True) for p in (MORE[kind], *FURTHER.get(kind, ()))]))
    # equal spans of several generators are neighbours now
    found = let(each, lambda all_: F.filter(all_, lambda s, i: F.coalesce((F.get(all_, i - 1)["start"] != s["start"]) | (F.get(all_, i - 1)["stop"] != s["stop"]), F.lit(True))))
    colons = lambda m: F.char_length(m) - F.char_length(F.translate(m, ":", ""))
    fits = lambda m: F.char_length(_digits(m)).between(low, high) & ((colons(m) <= COLONS) if kind == "ip" else F.lit(True))
    spans = F.filter(found, lambda s: fits(s["m"]))
    made = lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), *[c.cast("int").alias(n) for n, c in _features(kind, s).items()])
    return F.transform(spans, made)


def _all_candidates() -> Column:
    """Every candidate in the column text, with its features."""
    return F.concat(*[_candidates(k) for k in KINDS])


def _made(seed: int = 3, n: int = MADE) -> list[tuple[int, str]]:
    """Made texts with one candidate each, 1 for personal data: the same in every run."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choices("0123456789", k=k))
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randint(2, 9)))
    words = lambda low, high: " ".join(word() for _ in range(r.randint(low, high)))

    def check(digits: str) -> str:
        total = sum(int(c) if i % 2 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits)))
        return digits + str(-total % 10)

    out = []
    for _ in range(n):
        kind = r.randrange(20)
        if kind < 3:
            number = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)}/{d(7)}"[:14], f"0{d(9)}"])
            cue = r.choice(["tel", "phone", "call", "mobile", "call me at", "Tel", "fax", "cell"]) + r.choice([": ", " ", "."]) + r.choice(["", " "])
            out.append((1, f"{words(1, 6)} {cue}{number} {words(1, 5)}"))
        elif kind == 3:
            out.append((1, f"{words(1, 5)} {r.choice(['card', 'visa', 'credit card', 'payment card'])}{r.choice([' ', ': '])}{r.choice([' ', '.']).join(x for x in (d(4), d(4), d(4), d(4)))} {words(1, 4)}"))
        elif kind == 4:
            out.append((1, f"{words(1, 5)} {word()}{r.choice([' (at) ', '(at)', ' [at] ', '[at]'])}{word()}{r.choice(['.', ' [dot] ', '(dot)'])}com {words(1, 4)}"))
        elif kind == 5:
            out.append((1, f"{words(1, 5)} {':'.join(f'{r.randrange(1 << 16):x}' for _ in range(8))} {words(1, 4)}"))
        elif kind == 6:
            out.append((0, f"{words(1, 5)} {r.choice(['order', 'invoice', 'ref', 'isbn', 'serial', 'ticket', 'no', 'id', 'version', 'page', 'build', 'code'])}{r.choice([' ', ': ', '. ', ' #'])}{r.choice([f'{d(3)}-{d(2)}-{d(4)}', f'978-{d(1)}-{d(4)}-{d(4)}', f'{d(2)}-{d(5)}-{d(3)}', f'0{d(9)}', f'{d(4)}-{d(4)}-{d(4)}-{d(4)}', f'{d(4)} {d(6)} {d(5)}'])} {words(1, 4)}"))
        elif kind == 7:
            out.append((0, f"{words(1, 5)} {r.randint(1900, 2030)}{r.choice('-/.')}{r.randint(10, 12)}{r.choice('-/.')}{r.randint(10, 28)} {words(1, 4)}"))
        elif kind == 8:
            out.append((0, f"{words(1, 5)} {' '.join(d(r.randint(2, 5)) for _ in range(r.randint(3, 5)))} {words(1, 4)}"))
        elif kind == 9:
            out.append((0, f"{words(1, 5)} {d(2)}.{d(3)}.{d(3)} {words(1, 4)}"))
        elif kind == 10:
            out.append((0, f"{words(1, 5)} {d(4)}{r.choice(['', ' ', '-'])}{d(4)}{r.choice(['', ' ', '-'])}{d(4)}{d(r.randint(2, 5))} {words(1, 4)}"))
        elif kind == 11:
            out.append((0, f"{words(1, 5)} {d(3)}-{d(4)} {words(1, 4)}"))
        elif kind in (12, 16):
            number = r.choice([f"0{d(2)}/{d(7)}", f"0{d(3)} {d(7)}", f"0{d(2)} {d(8)}", f"(0{d(2)}) {d(7)}", f"0{d(3)}-{d(6)}", f"0{d(2)} {d(3)} {d(6)}", f"0{d(5)} {d(4)}"])
            cue = "" if kind == 16 else r.choice(["", r.choice(["tel", "phone", "call", "mobile", "Tel", "fax", "kontakt", "call me at"]) + r.choice([": ", " ", ". "])])
            lead = r.choice(["", words(1, 6) + r.choice([" ", ", ", ": ", " ("])]) if kind == 16 else words(1, 6) + " "
            out.append((1, f"{lead}{cue}{number}{r.choice([' ', '. ', ', '])}{words(1, 5)}"))
        elif kind == 13:
            number = r.choice([f"{d(r.randint(2, 5))}{r.choice(' -/.')}{d(r.randint(6, 10))}", f"0{d(2)}/{d(7)}", f"{d(3)} {d(2)} {d(7)}", f"0{d(6)}-{d(4)}"])
            lead = r.choice(["order", "invoice", "ref", "isbn", "serial", "ticket", "no", "id", "build", "code"]) + r.choice([" ", ": ", ". ", " #"])
            out.append((0, f"{words(1, 5)} {lead}{number} {words(1, 4)}"))
        elif kind == 18:
            out.append((1, f"{words(1, 5)} {word()} at {word()} dot {r.choice(['com', 'org', 'de', 'net', 'fr', 'co dot uk'])} {words(1, 4)}"))
        elif kind == 19:
            out.append((0, f"{words(1, 5)} {word()} at {word()} dot {word()} {words(1, 4)}"))
        elif kind in (14, 17):
            part = lambda most: ":".join(f"{r.randrange(1 << 16):x}" for _ in range(r.randint(1, most)))
            out.append((1, f"{words(1, 5)} {r.choice([f'fe80::{part(4)}', f'2001:db8::{part(4)}', f'2a0{d(1)}:{part(2)}::{d(1)}', f'::{part(3)}:{d(1)}', f'2001:{part(2)}::', f'fe80::{d(1)}'])}{r.choice([' ', '. ', ', '])}{words(1, 4)}"))
        else:
            name = lambda: r.choice("add bad face dead feed cafe fade ace bed dad a b c d e f ab cd".split())
            out.append((0, f"{words(1, 5)} {r.choice([f'{name()}::{name()}', f'::{name()}', f'{name()}::'])} {words(1, 4)}"))
    return out


_fitted: list[tuple[boosting.Trees, dict[str, float]]] = []


def bars(margins: np.ndarray, y: np.ndarray, of: np.ndarray) -> dict[str, float]:
    """Each kind's bar as log-odds: the least by which PRECISION of the candidates at or above it are positive, counting one
    negative more, within LEAST and MOST; MOST if there is none."""
    odds = lambda p: float(np.log(p / (1 - p)))
    out = {}
    for kind in KINDS:
        order = np.argsort(-margins[of == kind])
        held = margins[of == kind][order]
        precision = np.cumsum(y[of == kind][order]) / (np.arange(len(held)) + 2)
        # a bar takes in all candidates of its margin
        last = np.r_[held[1:] != held[:-1], True] if len(held) else np.empty(0, bool)
        good = held[last & (precision >= PRECISION)]
        out[kind] = min(max(float(good.min()) if len(good) else odds(MOST), odds(LEAST)), odds(MOST))
    return out


def fit(spark: SparkSession) -> tuple[boosting.Trees, dict[str, float]]:
    """Trees over the features of candidates in made texts, of which one in four calibrates, and each kind's bar (`bars`).

    The texts are the same in every run and nothing of the input is learned from, so a process fits once.
    """
    if _fitted:
        return _fitted[0]
    packed = "\u0001".join(f"{y}{text}" for y, text in _made())
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(packed), "\u0001")).alias("i", "row"))
    rows = rows.select("i", F.substring("row", 1, 1).cast("int").alias("y"), F.expr("substring(row, 2)").alias("text"))
    found = rows.select("i", "y", F.explode(_all_candidates()).alias("c")).select("i", "y", *[F.col(f"c.{n}") for n in NAMES]).collect()
    x = np.array([[r[n] for n in NAMES] for r in found], float)
    y, aside = np.array([r["y"] for r in found], float), np.array([r["i"] % 4 == 0 for r in found])
    model = boosting.calibrate(boosting.fit(x[~aside], y[~aside], NAMES), x[aside], y[aside])
    of = np.array(KINDS)[x[aside][:, [NAMES.index(f"is_{k}") for k in KINDS]].argmax(axis=1)]
    _fitted.append((model, bars(model.margins(x[aside]), y[aside], of)))
    return _fitted[0]


def spans(docs: DataFrame, threshold: float | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, base and added, each an array of (kind, start, stop); text if wanted.

    base has the matches of the BASE patterns that pass their checks, by kind as in KINDS and then by start. added has
    the candidates of the MORE and FURTHER generators whose calibrated probability reaches their kind's bar, or `threshold`
    if given, that overlap no base span and no better candidate (a larger probability, then an earlier start, then the
    longer one). Places are code points, stop exclusive. Null text is empty. Very long texts are searched whole: spans are
    placed and compared with their neighbours only, in time nearly in proportion to their number. Rows that repeat are each
    searched; extra columns are ignored; an empty table gives none.
    """
    model, least = fit(docs.sparkSession)
    if threshold is not None:
        least = dict.fromkeys(KINDS, float(np.log(threshold / (1 - threshold))))
    rows = columns_of(docs, ["doc_id", "text"], "personal data").select("doc_id", text_of("text").alias("text"))

    def named(kind: str) -> Column:
        passed = F.filter(_found(BASE[kind], NEEDS[kind]), lambda s: _passes(kind, s["m"]))
        return F.transform(passed, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    rated = f"transform(proposed, c -> struct(c.start AS start, c.stop AS stop, c.kind AS kind, {model.sql('c.')} AS p))"
    kept = ["doc_id", *["text"] * with_text]
    found = rows.select(*kept, F.concat(*[named(k) for k in KINDS]).alias("base"), _all_candidates().alias("proposed"))

    def reaches(c: Column) -> Column:
        bar = F.lit(least[KINDS[0]])
        for kind in KINDS[1:]:
            bar = F.when(c["kind"] == kind, least[kind]).otherwise(bar)
        return c["p"] >= bar

    def better(o: Column, c: Column) -> Column:
        return (o["p"] > c["p"]) | ((o["p"] == c["p"]) & ((o["start"] < c["start"]) | ((o["start"] == c["start"]) & ((o["stop"] > c["stop"]) | ((o["stop"] == c["stop"]) & (o["kind"] < c["kind"]))))))

    def of(spans_: Column, name: str) -> Column:
        return F.transform(spans_, lambda s: s[name])

    def free(likely: Column) -> Column:
        """Candidates, by start, that overlap no base span: none of those that begin before its stop ends after its start."""
        base = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
        reach = F.struct(tops(of(base, "stop")).alias("tops"), ranks(of(base, "start"), of(likely, "stop"), equal=False).alias("before"))
        alone = let(reach, lambda r: F.filter(likely, lambda c, i: F.get(r["tops"], F.get(r["before"], i)) <= c["start"]))
        return F.when((F.size(likely) == 0) | (F.size("base") == 0), likely).otherwise(alone)

    def best(alone: Column) -> Column:
        """Candidates, by start, that no better one overlaps: those that may overlap one lie between two places."""

        def judged(r: Column) -> Column:
            # the first candidate up to which one ends after the start, and the first that begins at the stop or later
            low = ranks(F.slice(r["tops"], F.lit(2), F.size(alone)), of(alone, "start"), equal=True)
            return let(low, lambda lows: F.filter(alone, lambda c, i: ~F.exists(F.sequence(F.get(lows, i), F.get(r["high"], i) - 1), lambda j: rival(F.get(alone, j), c))))

        def rival(o: Column, c: Column) -> Column:
            return (o["start"] < c["stop"]) & (c["start"] < o["stop"]) & better(o, c)

        reach = F.struct(tops(of(alone, "stop")).alias("tops"), ranks(of(alone, "start"), of(alone, "stop"), equal=False).alias("high"))
        return F.when(F.size(alone) < 2, alone).otherwise(let(reach, judged))

    seen = found.select(*kept, "base", F.array_sort(F.filter(F.expr(rated), reaches)).alias("likely"))
    chosen = let(let(F.col("likely"), free), best)
    return seen.select(*kept, "base", F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))).alias("added"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256 over them, and all spans as text."""

    def of(kind: str, held: Column) -> Column:
        return F.filter(held, lambda s: s["kind"] == kind)

    each = [of(k, F.concat("base", "added")) for k in KINDS]
    counts = [F.size(of(k, F.col("base"))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat(*[F.array_sort(e) for e in each])).alias("spans"))


def redact(docs: DataFrame, threshold: float | None = None) -> DataFrame:
    """doc_id and text with every span (see `spans`) replaced by <KIND>; where spans overlap, one mark covers them.

    The text is cut into segments once, and what stands between spans is taken from those.
    """
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def marked(r: Column) -> Column:
        spans_, covered, cut = r["spans"], r["covered"], r["cut"]

        def part(s: Column, i: Column) -> Column:
            mark = F.concat(piece(cut, F.get(covered, i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            return F.when(s["start"] < F.get(covered, i), F.lit("")).otherwise(mark)

        tail = piece(cut, F.get(covered, F.size(spans_)), F.char_length("text"))
        return F.concat(F.array_join(F.transform(spans_, part), ""), tail)

    reach = let(ordered, lambda o: F.struct(o.alias("spans"), tops(F.transform(o, lambda s: s["stop"])).alias("covered"), segments(F.col("text")).alias("cut")))
    return spans(docs, threshold, with_text=True).select("doc_id", F.when(F.size("base") + F.size("added") == 0, F.col("text")).otherwise(let(reach, marked)).alias("text"))
