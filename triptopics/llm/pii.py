"""Personal data: exact base patterns, and a conditional random field for what they miss.

Base spans follow fixed patterns (leftmost, non-overlapping for each kind; failing matches dropped).
A linear-chain CRF over word shapes, trained from a small labelled table, adds spans of the same
kinds in other spellings (national phone numbers, addresses without a top-level domain, ...); an
added span overlaps no base span, and base spans stay as they are.  Personal data of these kinds
holds a digit or an ``@``, so the chain is decoded around such words (with ``CONTEXT`` words on
either side); all other words are outside.

Null text is the empty text; a null doc_id stays null; repeated rows are judged alike; an empty
table gives an empty result; extra columns are ignored by ``personal_data`` and kept by ``redacted``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import row_blocks, text_view

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
MAX_TRAIN_ROWS = 2_000
CONTEXT = 3

Span = tuple[int, int]

# --- base patterns ---------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[Span]:
    """Found from each ``@`` outwards, so a long run without one costs nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]


BASE = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> dict[str, list[Span]]:
    return {k: find(text) for k, find in BASE.items()}


def shown(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


# --- the random field ------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|[\d_]")
_WORD = re.compile(r"\S+")
_SIGN = re.compile(r"[0-9@]")


def segments(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of words around every word with a digit or ``@``, ``CONTEXT`` words on either side."""
    words: list[Span] = []
    begin, end, behind = -1, -1, 0
    for m in _WORD.finditer(text):
        words = [*words[-CONTEXT:], m.span()]
        if _SIGN.search(m[0]):
            if begin < 0:
                begin = words[0][0]
            end, behind = m.end(), CONTEXT
        elif begin >= 0:
            if behind:
                end, behind = m.end(), behind - 1
            else:
                yield begin, end
                begin, words = -1, words[-1:]
    if begin >= 0:
        yield begin, end


def shape(token: str) -> str:
    if token.isascii() and token.isdigit():
        return "d" + str(min(len(token), 8))
    if token.isalpha():
        kind = "X" if token.isupper() else "x" if token.islower() else "Xx"
        return kind + ("+" if len(token) > 4 else "")
    return token if token.isascii() else "u"


def features(text: str, spans: Sequence[Span]) -> list[list[str]]:
    """Word-shape features of each token: its own shape, its neighbours', whether they touch, cue words."""
    tokens = [text[a:b] for a, b in spans]
    shapes = [shape(t) for t in tokens]
    glued = [k > 0 and spans[k - 1][1] == spans[k][0] for k in range(len(spans))] + [False]
    at = lambda k: shapes[k] if 0 <= k < len(shapes) else "-"
    out, cue = [], "-"
    for k, token in enumerate(tokens):
        g, h = "g" if glued[k] else "_", "g" if glued[k + 1] else "_"
        out.append(["b", f"s={at(k)}", f"p={at(k - 1)}{g}", f"n={h}{at(k + 1)}", f"ps={at(k - 1)}{g}{at(k)}", f"sn={at(k)}{h}{at(k + 1)}",
                    f"psn={at(k - 1)}{g}{at(k)}{h}{at(k + 1)}", f"pp={at(k - 2)}{at(k - 1)}{g}{at(k)}", f"nn={at(k)}{h}{at(k + 1)}{at(k + 2)}", f"c={cue}|{at(k)}"])
        if token.isalpha():
            cue = token.lower()
    return out


def tokens_of(text: str, begin: int, end: int) -> list[Span]:
    return [m.span() for m in _TOKEN.finditer(text, begin, end)]


def _plausible(kind: str, found: str) -> bool:
    d = _digits(found)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]*[^\W\d_][^\s@]*", found))
    if kind == "ip":
        return bool(ips(found)) and ips(found)[0] == (0, len(found))
    return 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 7 <= len(d) <= 15


def added_spans(model: crf.Model, texts: Sequence[str], base: Sequence[dict[str, list[Span]]]) -> list[dict[str, list[Span]]]:
    """Spans that the field finds beside the base spans of each text."""
    where, feats, spans = [], [], []
    for r, text in enumerate(texts):
        for a, b in segments(text):
            if toks := tokens_of(text, a, b):
                where.append(r)
                spans.append(toks)
                feats.append(features(text, toks))
    out: list[dict[str, list[Span]]] = [{k: [] for k in KINDS} for _ in texts]
    for r, toks, path in zip(where, spans, model.decode(feats), strict=True):
        taken = sorted(s for v in base[r].values() for s in v)
        for kind, a, b in tagged(toks, path):
            if _plausible(kind, texts[r][a:b]) and not any(x < b and a < y for x, y in taken):
                out[r][kind].append((a, b))
    return out


def tagged(toks: Sequence[Span], path: np.ndarray) -> Iterator[tuple[str, int, int]]:
    kind, start, end = "", 0, 0
    for (a, b), t in zip(toks, path, strict=True):
        tag = TAGS[t]
        if tag[0] == "I" and kind == tag[2:]:
            end = b
            continue
        if kind:
            yield kind, start, end
        kind, start, end = ("" if tag == "O" else tag[2:]), a, b
    if kind:
        yield kind, start, end


# --- the labelled table ----------------------------------------------------------------------

_FORMS = {
    "phone": ("(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "+d (ddd) ddd-dddd", "+dd ddd ddddddd", "0dd dddd dddd", "00dd ddd dddddd", "+ddddddddddd", "0ddd-ddddddd"),
    "email": ("aaaa@aaaaaa", "aaaa.aaaa@aaaaa.aaa", "aaaaad@aaaa.aaa.aa", "aaa_dd@aaaaaa.aa", "aaaaa.dd@aaaad.aaaaaaa.aaa", "aa-aaa@aaaaaaa"),
    "ip": ("d.d.d.d", "ddd.ddd.d.dd", "ddd.dd.dd.ddd", "dd.ddd.ddd.d"),
    "card": ("dddd dddd dddd dddd", "dddd-dddd-dddd-dddd", "dddddddddddddddd", "dddd dddddd ddddd", "ddddddddddddddd"),
    "": ("dddd-dd-dd", "dd:dd", "d.d.d", "v d.dd", "$dd.dd", "dd %", "dddd", "d", "dd/dd/dddd", "#dddd", "ddadaadddadd", "ddd,ddd", "ddddddddddddddddddddd", "dd x dd",
         "dd-dd", "@aaaaa", "a = dd", "ddddd", "d.dd", "ISBN ddd-d-dd-dddddd-d", "lines dd to ddd", "page ddd"),
}
_AROUND = (("call", "today"), ("phone", "or"), ("write to", "now"), ("mail", "."), ("reach us at", "please"), ("server", "is down"), ("from", "to"), ("paid with", "on"),
           ("the", "of"), ("in", "and"), ("number", ","), ("contact", "for more"), ("card", "was used"), ("", ""))


def labelled_examples(spark: SparkSession, copies: int = 6, seed: int = 7) -> DataFrame:
    """text, kind, start, end: short sentences with one marked span, or a number of no kind (kind empty)."""
    rng = np.random.default_rng(seed)
    rows = []
    for kind, forms in _FORMS.items():
        for form in forms:
            for _ in range(copies):
                body = "".join(str(rng.integers(0, 10)) if c == "d" else chr(97 + rng.integers(0, 26)) if c == "a" else c for c in form)
                before, after = _AROUND[rng.integers(0, len(_AROUND))]
                filler = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(4)]
                lead = " ".join([*filler[:2], before]).strip() + " "
                tail = ("" if after in (".", ",") else " ") + " ".join([after, *filler[2:]]).strip()
                rows.append((lead + body + tail, kind, len(lead), len(lead) + len(body)))
    return spark.createDataFrame(rows, "text string, kind string, start int, end int")


def trained(labelled: DataFrame) -> crf.Model:
    """Fit the field to a labelled table of at most ``MAX_TRAIN_ROWS`` rows (text, kind, start, end)."""
    rows = labelled.select("text", "kind", "start", "end").orderBy("text", "start", "end", "kind").take(MAX_TRAIN_ROWS + 1)
    if len(rows) > MAX_TRAIN_ROWS:
        raise ValueError(f"the labelled table has more than {MAX_TRAIN_ROWS} rows")
    seqs, labels = [], []
    for text, kind, start, end in rows:
        toks = tokens_of(text, 0, len(text))
        inside = [kind != "" and start <= a and b <= end for a, b in toks]
        seqs.append(features(text, toks))
        labels.append([TAGS.index(f"{'I' if k and inside[k - 1] else 'B'}-{kind}") if inside[k] else 0 for k in range(len(toks))])
    return crf.train(seqs, labels, TAGS)


# --- operators -------------------------------------------------------------------------------

FOUND = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[[*range(0x30, 0x3A), 0x40]] = True
_NOTHING = ([0] * len(KINDS), sha256(b"").hexdigest(), "", 0)


def with_candidates(col: pa.Array) -> np.ndarray:
    """Row numbers of the texts with a digit or ``@``; no other text can hold a span."""
    data, off = text_view(col)
    found = [np.zeros(0, np.int64)]
    for i, j in row_blocks(off):
        n = np.concatenate([[0], np.cumsum(_CANDIDATE[data[off[i]:off[j]]])])
        o = off[i:j + 1] - off[i]
        found.append(i + np.flatnonzero(n[o[1:]] > n[o[:-1]]))
    return np.concatenate(found)


def all_spans(model: crf.Model, texts: Sequence[str]) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    base = [base_spans(t) for t in texts]
    return list(zip(base, added_spans(model, texts, base), strict=True))


def personal_data(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``FOUND`` for every document: base counts and digest, all spans, and how many the field added."""
    model = trained(labelled if labelled is not None else labelled_examples(docs.sparkSession))

    def run(batches):
        for batch in batches:
            col = batch.column("text")
            rows = [_NOTHING] * len(col)
            at = with_candidates(col)
            texts = col.take(pa.array(at)).to_pylist()
            for r, (base, more) in zip(at, all_spans(model, texts), strict=True):
                rows[r] = ([len(base[k]) for k in KINDS], sha256(shown(base).encode()).hexdigest(),
                           shown({k: base[k] + more[k] for k in KINDS}), sum(map(len, more.values())))
            counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(len(KINDS))),
                 pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())],
                names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """``text`` with every span replaced by its kind; overlapping spans become the first one's kind."""
    out, end = [], 0
    for a, b, kind in sorted((a, -b, k) for k in KINDS for a, b in spans[k]):
        b = -b
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redacted(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; a null text stays null, other columns stay."""
    model = trained(labelled if labelled is not None else labelled_examples(docs.sparkSession))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = texts.copy()
        at = [k for k, t in enumerate(texts) if isinstance(t, str) and _SIGN.search(t)]
        for k, (base, more) in zip(at, all_spans(model, [texts.iloc[k] for k in at]), strict=True):
            out.iloc[k] = redact(texts.iloc[k], {x: base[x] + more[x] for x in KINDS})
        return out

    return docs.withColumn("text", clean(F.col("text")))
