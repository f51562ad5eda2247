"""Personal data: base patterns, and what a character-level bidirectional LSTM with CRF transitions adds to them.

Base spans are the leftmost non-overlapping matches of each kind's pattern; a match that fails its kind's test is
dropped without a retry. The model is trained in numpy on about SAMPLE_DOCS documents with a digit or an @: on the spans
that the base patterns label there, some of them rewritten into FORMS that the patterns miss, on more items of such forms
and on innocent digits put in between; WINDOWS_A_TEXT windows of a text are drawn over its whole length. It decodes
windows of WIDTH characters, STRIDE apart, over the whole text; each character takes its tag from the window in whose
middle it lies, and runs of one kind are joined over window bounds. A decoded span is trimmed to characters of its kind
and grown to the whole number or address that it cuts, and added if it passes its kind's test and touches no base span.
Every test needs a digit or an @, so windows without either can start no span and aren't decoded; an address that goes on
into such a window is grown there.

Edge cases: a null text has no spans; without a sample with personal data nothing is added; offsets are code points,
end exclusive; rows are handled one by one, so repeated rows agree; an empty table gives no rows; other columns pass
(`pii` is replaced).
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bilstm_crf import BiLstmCrf, codes
from .common import give_back, shield, small_batches, table

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE, MARGIN = 96, 48, 24
SAMPLE_DOCS = 1500
INSERTED = 6  # items put into each text of the sample
WINDOWS_A_TEXT = 12  # drawn at random over the whole text
STEPS = 400

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does: from within a run it would end like the match from the run's start.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_BLANK = re.compile(r"\s")
# What an added span of each kind may look like.
_NUMBER = re.compile("[0-9]+")
_ADDED = {
    "email": re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z][A-Za-z0-9._%+-]*\s?@\s?[A-Za-z0-9-]*[A-Za-z][A-Za-z0-9.-]*"),
    "ip": re.compile(r"[0-9]{1,3}(?:[\[\]() .,]{1,3}[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[./\x20-]{0,3}[0-9])+"),
    "phone": re.compile(r"[(+0-9](?:[()./\x20-]{0,2}[0-9])+"),
}
PII = "pii array<struct<kind: string, start: long, end: long, base: boolean>>"


def _digits(s: str) -> list[int]:
    return [int(c) for c in s if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def passes(kind: str, s: str) -> bool:
    if kind == "email":
        return "@" in s
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    d = _digits(s)
    return 16 <= len(d) <= 19 and luhn(d) if kind == "card" else 8 <= len(d) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end by kind as listed, then start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if passes(kind, m.group())]
    return out


def _grouped(d: str, sep: str, *sizes: int) -> str:
    """Digits in groups of these sizes, the rest in the last."""
    cuts = np.cumsum([0, *sizes])
    return sep.join([*(d[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), d[cuts[-1] :]])


#: Ways to write personal data that the base patterns miss, by name: the kind, and a function of some digits (or of the plain address).
FORMS: dict[str, tuple[str, Callable[[str], str]]] = {
    "phone-brackets": ("phone", lambda d: f"({d[:3]}) {d[3:6]}-{d[6:10]}"),
    "phone-brackets-spaces": ("phone", lambda d: f"({d[:4]}) {d[4:7]} {d[7:11]}"),
    "phone-dashes": ("phone", lambda d: _grouped(d[:10], "-", 3, 3)),
    "phone-dots": ("phone", lambda d: _grouped(d[:10], ".", 3, 3)),
    "phone-spaces": ("phone", lambda d: "0" + _grouped(d[:10], " ", 3, 3)),
    "phone-slash": ("phone", lambda d: f"0{d[:3]}/{d[3:10]}"),
    "phone-00": ("phone", lambda d: f"00{d[:2]} {d[2:5]} {d[5:12]}"),
    "phone-00-groups": ("phone", lambda d: "00" + _grouped(d[:11], " ", 2, 2, 3)),
    "phone-00-dashes": ("phone", lambda d: "00" + _grouped(d[:11], "-", 2, 3)),
    "card-dots": ("card", lambda d: _grouped(d, ".", 4, 4, 4)),
    "card-slashes": ("card", lambda d: _grouped(d, "/", 4, 4, 4)),
    "card-two-spaces": ("card", lambda d: _grouped(d, "  ", 4, 4, 4)),
    "card-spaced-dashes": ("card", lambda d: _grouped(d, " - ", 4, 4, 4)),
    "email-no-dot": ("email", lambda s: s.split("@")[0] + "@" + s.split("@")[1].split(".")[0]),
    "email-spaced": ("email", lambda s: s.replace("@", " @ ")),
    "email-space-after": ("email", lambda s: s.replace("@", "@ ")),
    "email-space-before": ("email", lambda s: s.replace("@", " @")),
    "ip-bracketed-dots": ("ip", lambda s: s.replace(".", "[.]")),
    "ip-last-dot-bracketed": ("ip", lambda s: "[.]".join(s.rsplit(".", 1))),
    "ip-spaced-dots": ("ip", lambda s: s.replace(".", " . ")),
    "ip-commas": ("ip", lambda s: s.replace(".", ",")),
}


def _random_digits(g: np.random.Generator, n: int) -> str:
    return str(g.integers(1, 10)) + "".join(map(str, g.integers(0, 10, n - 1)))


def card_number(g: np.random.Generator) -> str:
    """16 random digits that pass Luhn."""
    d = _random_digits(g, 15)
    return next(d + str(c) for c in range(10) if luhn(_digits(d + str(c))))


def plain(kind: str, g: np.random.Generator, words: list[str]) -> str:
    """Digits (of a phone or card) or an address to write in one of FORMS."""
    if kind == "phone":
        return _random_digits(g, 12)
    if kind == "card":
        return card_number(g)
    if kind == "ip":
        return ".".join(map(str, g.integers(0, 256, 4)))
    local, host = ("".join(c for c in words[int(g.integers(len(words)))].lower() if c in _LOCAL and c.isalpha()) or "box" for _ in "ab")
    return f"{local}{['', '.' + str(g.integers(100)), str(g.integers(100)), '_x', '.' + host][g.integers(5)]}@{host}{['', str(g.integers(10))][g.integers(2)]}.{['com', 'org', 'net', 'de', 'example.com'][g.integers(5)]}"


def innocent(g: np.random.Generator) -> str:
    """Digits that are no personal data: dates, times, amounts, versions, counts, keys."""
    n = lambda a, b: int(g.integers(a, b))
    sep = ["-", "/", ".", ". "][n(0, 4)]
    date = f"{n(1, 32):02d}{sep}{n(1, 13):02d}{sep}{n(1900, 2100)}"
    return [date, f"{n(1900, 2100)}-{n(1, 13):02d}-{n(1, 32):02d}", f"{date} {n(0, 24):02d}.{n(0, 60):02d}", f"{n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}", f"{n(0, 1000)}.{n(0, 100):02d}", f"{n(1, 1000)},{n(0, 1000):03d},{n(0, 1000):03d}", f"{n(1, 1000)} {n(0, 1000):03d} {n(0, 1000):03d}", f"{n(0, 20)}.{n(0, 20)}.{n(0, 200)}", f"{n(1, 60)}.", str(n(0, 10 ** n(1, 8))), f"{n(1, 400)}-{n(1, 400)}", f"{n(1, 60)}.{n(1, 20)}.", f"({n(1, 3000)})", "".join("0123456789abcdef"[i] for i in g.integers(0, 16, n(12, 40))), f"{n(1900, 2100)}/{n(1, 100)}", f"@{_random_digits(g, 3)}", "@ " + str(n(1, 100))][n(0, 17)]


def _training(texts: list[str], g: np.random.Generator, forms: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and BIO tags of the texts, whose labelled spans are partly rewritten and into which INSERTED more items of personal data and of innocent digits are put.

    A number that has a card's pattern and only fails Luhn is tagged as one: the test of added spans settles that.
    """
    xs, ys = [], []
    names = {k: [f for f in forms if FORMS[f][0] == k] for k in KINDS}
    for text in texts:
        words = text[:2000].split() or ["box"]
        spans = {(a, b): kind for kind, a, b in reversed(base_spans(text))}
        spans |= {m.span(): "card" for m in _CARD.finditer(text) if 16 <= len(_digits(m.group())) <= 19 and m.span() not in spans}
        blanks = [m.start() for m in _BLANK.finditer(text)]
        items: list[tuple[int, int, str, str | None]] = []  # start, end, what stands there in training, kind
        for (a, b), kind in spans.items():
            new = text[a:b]
            if g.random() < 0.4 and names[kind]:
                new = FORMS[names[kind][int(g.integers(len(names[kind])))]][1](plain(kind, g, words))
            items.append((a, b, new, kind))
        for at in g.choice(blanks, min(INSERTED, len(blanks)), replace=False).tolist() if blanks else []:
            if g.random() < 0.5 and any(names.values()):
                kind = [k for k in KINDS if names[k]][int(g.integers(sum(map(bool, names.values()))))]
                items.append((at, at, " " + FORMS[names[kind][int(g.integers(len(names[kind])))]][1](plain(kind, g, words)), kind))
            else:
                items.append((at, at, " " + innocent(g), None))
        parts, tags, marks, at, size = [], [], [], 0, 0
        for a, b, new, kind in sorted(items, key=lambda i: i[:2]):
            if a < at:
                continue
            lead = len(new) - len(new.lstrip(" ")) if a == b else 0
            parts += [text[at:a], new]
            size += a - at + len(new)
            marks.append(size - len(new) + lead)
            k = KINDS.index(kind) if kind else 0
            tags += [0] * (a - at + lead) + ([1 + 2 * k] + [2 + 2 * k] * (len(new) - lead - 1) if kind else [0] * (len(new) - lead))
            at = b
        x, y = codes("".join([*parts, text[at:]])), np.array(tags + [0] * (len(text) - at), np.uint8)
        digits = np.flatnonzero((x > 48) & (x < 59))
        marks = np.r_[np.array(marks, np.int64), g.choice(digits, min(2, len(digits)), replace=False)]
        for m in g.permutation(marks)[:WINDOWS_A_TEXT].tolist():
            a = m - int(g.integers(0, WIDTH))
            wx, wy = np.zeros(WIDTH, np.uint8), np.zeros(WIDTH, np.uint8)
            lo, hi = max(a, 0), min(a + WIDTH, len(x))
            wx[lo - a : hi - a], wy[lo - a : hi - a] = x[lo:hi], y[lo:hi]
            xs.append(wx)
            ys.append(wy)
    if not xs:
        return np.zeros((WIDTH, 0), np.uint8), np.zeros((WIDTH, 0), np.uint8)
    return np.array(xs).T, np.array(ys).T


def fit(texts: list[str], steps: int = STEPS, forms: tuple[str, ...] = tuple(FORMS)) -> BiLstmCrf | None:
    """A model of the spans that the base patterns label in the texts and of the given forms; None if no text has a span."""
    if not any(base_spans(t) for t in texts):
        return None
    model = BiLstmCrf(1 + 2 * len(KINDS))
    model.train(*_training(texts, np.random.default_rng(11), forms), steps)
    return model


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> BiLstmCrf | None:
    """A model from about `sample_docs` of the documents with a digit or an @, chosen by a hash of doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    some = docs.filter(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    n = some.count()
    if not n:
        return None
    sample = some.filter(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1 << 20)) < min(1.0, sample_docs / n) * (1 << 20))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pickle.dumps(fit(pdf.sort_values("doc_id")["text"].tolist(), steps))]})

    row = sample.groupBy(F.lit(0).alias("g")).applyInPandas(run, "model binary").first()
    return pickle.loads(row["model"]) if row else None


def _decoded(texts: list[str], model: BiLstmCrf) -> list[list[tuple[str, int, int]]]:
    """Spans of each text from all windows that hold a digit or an @."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    wins, where, tags = [], [], {}

    def flush() -> None:
        if wins:
            got = model.decode(np.array(wins).T).T
            for (i, w), t in zip(where, got, strict=True):
                tags[i, w] = t
        wins.clear()
        where.clear()

    lengths, wanted = {}, {}
    for i, text in enumerate(texts):
        x = codes(text)
        marks = np.flatnonzero(((x > 48) & (x < 59)) | (x == 65))
        last = max(0, -(-(len(x) - WIDTH) // STRIDE))
        hold = np.unique(np.r_[marks // STRIDE, marks // STRIDE - 1]) if len(marks) else np.zeros(0, int)
        lengths[i], wanted[i] = last, [int(w) for w in hold if 0 <= w <= last]
        for w in wanted[i]:
            win = np.zeros(WIDTH, np.uint8)
            part = x[w * STRIDE : w * STRIDE + WIDTH]
            win[: len(part)] = part
            wins.append(win)
            where.append((i, w))
            if len(wins) >= 1024:
                flush()
    flush()
    for i, text in enumerate(texts):
        pieces: list[list] = []  # kind, start, end, whether the last ran on to the end of its zone
        for w in wanted[i]:
            a, b = (0 if w == 0 else MARGIN), (WIDTH if w == lengths[i] else WIDTH - MARGIN)
            t, open_ = tags[i, w], False
            for p in range(a, b):
                at = w * STRIDE + p
                if at >= len(text) or not t[p]:
                    open_ = False
                    continue
                kind = KINDS[(t[p] - 1) // 2]
                goes_on = pieces and pieces[-1][2] == at and pieces[-1][0] == kind and (open_ and t[p] % 2 == 0 or p == a)
                if goes_on:
                    pieces[-1][2] = at + 1
                else:
                    pieces.append([kind, at, at + 1])
                open_ = True
        out[i] = [(k, s, e) for k, s, e in pieces]
    return out


def _grown(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """A decoded span from its first to its last character that can belong to one, with the rest of a number or word that it cuts."""
    if kind == "email":
        while a and text[a - 1] in _LOCAL:
            a -= 1
        while b < len(text) and (text[b] in _LOCAL or text[b] == "@"):
            b += 1
        while a < b and text[a] not in _LOCAL:
            a += 1
        while b > a and (text[b - 1] not in _LOCAL or text[b - 1] in "._%+-"):
            b -= 1
        return a, b
    if a < b and "0" <= text[a] <= "9":
        while a and "0" <= text[a - 1] <= "9":
            a -= 1
    while b < len(text) and a < b and "0" <= text[b] <= "9" and "0" <= text[b - 1] <= "9":
        b += 1
    while a < b and not ("0" <= text[a] <= "9" or kind == "phone" and text[a] in "(+"):
        a += 1
    while b > a and not "0" <= text[b - 1] <= "9":
        b -= 1
    return a, b


def added_passes(kind: str, s: str) -> bool:
    """The test of an added span: what its kind's characters and numbers may be, in whatever form."""
    if not _ADDED[kind].fullmatch(s):
        return False
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in _NUMBER.findall(s))
    return kind == "email" or passes(kind, s)


def added_spans(text: str, decoded: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out = []
    for kind, a, b in decoded:
        a, b = _grown(kind, text, a, b)
        if a < b and added_passes(kind, text[a:b]) and not any(x < b and a < y for _, x, y in [*base, *out]):
            out.append((kind, a, b))
    return out


def find(docs: DataFrame, model: BiLstmCrf | None) -> DataFrame:
    """docs with pii: kind, start, end, base of every span, by kind as in KINDS, then start."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    cols = [c for c in docs.columns if c != "pii"]
    pii = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            some = np.flatnonzero(pc.fill_null(pc.match_substring_regex(text, "[0-9@]"), False).to_numpy(zero_copy_only=False))
            found: list[list[dict]] = [[] for _ in range(len(text))]
            texts = text.take(pa.array(some)).to_pylist()
            decoded = _decoded(texts, shared.value) if shared.value and texts else [[]] * len(texts)
            for i, t, d in zip(some.tolist(), texts, decoded, strict=True):
                base = base_spans(t)
                spans = [(*s, True) for s in base] + [(*s, False) for s in added_spans(t, d, base)]
                spans.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                found[i] = [dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(found, pii)], [*cols, "pii"])
            give_back()

    docs = docs.select(*cols)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(PII).fields]))


def redact(docs: DataFrame, model: BiLstmCrf | None) -> DataFrame:
    """docs with every span, overlapping ones as one, replaced by its kind in brackets."""
    docs, back = shield(docs, "text")
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("pii").to_pylist()):
                if spans:
                    parts, at = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            parts += [texts[i][at : s["start"]], f"[{s['kind'].upper()}]"]
                        at = max(at, s["end"])
                    texts[i] = "".join([*parts, texts[i][at:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in cols], cols)

    return back(find(docs, model).mapInArrow(run, docs.schema))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest; n_<kind> count the base spans, n_added those of the model, n_spans all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs)).select("doc_id", "pii")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("pii").to_pylist()
            text = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
            base = [[s for s in spans if s["base"]] for spans in every]
            counts = [pa.array([sum(s["kind"] == k for s in spans) for spans in base], pa.int64()) for k in KINDS]
            added = pa.array([len(x) - len(y) for x, y in zip(every, base, strict=True)], pa.int64())
            total = pa.array([len(x) for x in every], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([hashlib.sha256(text(x).encode()).hexdigest() for x in base], pa.string()), pa.array([text(x) for x in every], pa.string()), added, total], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    return found.mapInArrow(digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
