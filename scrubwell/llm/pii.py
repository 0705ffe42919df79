r"""Operator 8: personal data, and what gives it away: information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers by their patterns. On top,
corpus co-occurrence estimates how strongly the words around a protected value reveal it: with document
counts n over the whole corpus of N documents, a term t discloses an entity e if

    PMI(t; e) = log2(N n(t, e) / (n(t) n(e)))  >=  alpha * IC(e),  IC(e) = log2(N / n(e)),

that is, if the term leaves less than the share 1 - alpha of the entity's information untold. n(t, e) counts the
documents where t stands within ``WINDOW`` words of e. Entities are the values, one for all spellings of a number,
and what values share: an e-mail's domain and its local part, an IP's first three octets, a card's issuer, a
phone's country and area. Pairs with ``SUPPORT`` such documents are judged by their counts. Most values are in fewer
documents than that; for those ``DISCOUNT`` is taken off n(t, e), which leaves only terms that are rare
everywhere. A disclosing term is removed wherever it stands in a text that mentions its entity, and, if its pair has the
support, in every other text too, as it tells the entity there as well. (Without support a pair is one meeting of two rare
things, which says nothing about a text with only one of them.) Terms from ``alpha`` up to ``remove`` of the information
are generalised to their kind instead.

Counts: pairs and entities are aggregated over all documents. Term counts are needed for terms of
judged pairs only; a bitmap of fixed size lets the other words of a text drop out before the shuffle,
and the join that follows is exact. Hashes of 64 bits stand for terms and entities. Words that a worker remembers are
bounded in number and length.

Null and empty texts have no span. Repeated rows each count as documents and get equal spans; null ids stay;
an empty table gives an empty result; further columns aren't read, and keep their values whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.llm.common import cut, free_names, map_rows, maybe_in, read_table

KINDS = ("email", "ip", "card", "phone")
WINDOW = 10
SUPPORT = 3
DISCOUNT = 0.5
ALPHA = 0.8
REMOVE = 0.95
BITMAP_BITS = 23
#: Distinct terms whose counts a task holds before it hands them on.
HELD_TERMS = 200_000
#: Bytes of the longest word that a task remembers.
LONG_WORD = 64

_HINT = re.compile(r"[0-9@]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never starts inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'.,;:!?()[]{}<>*#%&$|/\\-_`~+="


def emails(text: str) -> list[tuple[int, int]]:
    """By each ``@``, so that long runs of address signs without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL_SIGNS:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((left, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _octets(value: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in value.split("."))


def _luhn(value: str) -> bool:
    digits = [ord(c) - 48 for c in value if c not in " -"]
    if not 16 <= len(digits) <= 19:
        return False
    total = sum(digits[-1::-2]) + sum(d * 2 - 9 * (d > 4) for d in digits[-2::-2])
    return total % 10 == 0


def _dialled(value: str) -> bool:
    return 8 <= sum("0" <= c <= "9" for c in value) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end in code points, by kind as listed, then start."""
    if not _HINT.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    for kind, pattern, ok in (("ip", _IP, _octets), ("card", _CARD, _luhn), ("phone", _PHONE, _dialled)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if ok(m[0])]
    return out


def written(spans) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def term_hash(term: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(term.encode()))


def _terms(text: str) -> Iterator[tuple[str, int, int]]:
    """Normalised words with their spans; '' for words that are no term."""
    for m in _WORD.finditer(text):
        raw = m[0]
        a = m.start() + len(raw) - len(raw.lstrip(_EDGE))
        core = raw.strip(_EDGE)
        term = core.lower()
        yield (term if len(core) >= 3 and any(c.isalpha() for c in core) else ""), a, a + len(core)


def entities(kind: str, value: str) -> tuple[str, list[str]]:
    """The entity of a value in its plain spelling, and those of what it shares with others."""
    if kind == "email":
        local, _, domain = value.lower().partition("@")
        return f"email:{local}@{domain}", [f"domain:{domain}", f"person:{local}"]
    if kind == "ip":
        octets = [str(int(x.lstrip("0") or "0")) for x in value.split(".")]
        return f"ip:{'.'.join(octets)}", [f"network:{'.'.join(octets[:3])}"]
    digits = "".join(c for c in value if "0" <= c <= "9")
    return f"{kind}:{digits}", [f"issuer:{digits[:6]}" if kind == "card" else f"area:{digits[:4]}"]


def _outside(words: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The words with '' for those that touch a base span."""
    taken = sorted((a, b) for _, a, b in spans)
    lows = [a for a, _ in taken]
    reach = list(np.maximum.accumulate([b for _, b in taken]))
    out = []
    for term, s, e in words:
        k = bisect_left(lows, e) - 1
        out.append(("" if k >= 0 and reach[k] > s else term, s, e))
    return out


def contexts(text: str, spans: list[tuple[str, int, int]], window: int) -> tuple[list[list[int]], list[list[int]]]:
    """Distinct entity and term hashes of the words around base spans, for values, then for what they share."""
    words = _outside(list(_terms(text)), spans)
    starts = [w[1] for w in words]
    own, shared = {}, {}
    for kind, a, b in spans:
        value, groups = entities(kind, text[a:b])
        lo, hi = bisect_left(starts, a), bisect_left(starts, b)
        around = [term_hash(term) for term, _, _ in words[max(0, lo - window) : hi + window] if term]
        own.setdefault(term_hash(value), set()).update(around)
        for g in groups:
            shared.setdefault(term_hash(g), set()).update(around)
    flat = lambda of: [[e for e, ts in of.items() for _ in ts], [t for ts in of.values() for t in ts]]
    return flat(own), flat(shared)


def occurrences(text: str, told: dict[int, float]) -> list[tuple[int, int, float]]:
    """Start, end and ``told`` of each word outside base spans whose hash is in ``told``."""
    words = _outside(list(_terms(text)), base_spans(text))
    return [(s, e, told[h]) for term, s, e in words if term and (h := term_hash(term)) in told]


def scan(df: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: its identity, ``base`` (written spans), counts, digest, pairs of entities and terms, and the text if it has spans."""
    k, t = df[key].cast("long"), df[text].cast("string")
    source = df.select(F.coalesce(k, F.lit(-1)).alias("row_id"), F.xxhash64(k, t).alias("row_hash"), k.alias("key"), t.alias("text"))

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for row_id, row_hash, key, t in it:
            spans = base_spans(t) if t else []
            n = Counter(s[0] for s in spans)
            base = written(spans)
            own, shared = contexts(t, spans, window) if spans else ([[], []], [[], []])
            digest = hashlib.sha256(base.encode()).hexdigest()
            yield row_id, row_hash, key, *(n[kind] for kind in KINDS), digest, base, *own, *shared, t if spans else None

    longs = pa.list_(pa.int64())
    schema = pa.schema(
        [(x, pa.int64()) for x in ("row_id", "row_hash", "key", "n_email", "n_ip", "n_card", "n_phone")]
        + [("base_sha256", pa.string()), ("base", pa.string()), ("entity", longs), ("term", longs), ("group", longs), ("group_term", longs), ("text", pa.string())]
    )
    names = "row_id long, row_hash long, key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string"
    return map_rows(source, run, names + ", entity array<long>, term array<long>, group array<long>, group_term array<long>, text string", schema)


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Fixed-size bitmap of term hashes; at most 2**17 words of 64 bits reach the driver."""
    bit = F.pmod("term", F.lit(1 << BITMAP_BITS))
    words = terms.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")
    )
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    table = words.toArrow()
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


class _Wanted:
    """The terms of a text whose hashes a bitmap has."""

    def __init__(self, packed: np.ndarray):
        self.bits, self.mask = np.unpackbits(packed).astype(bool), (1 << BITMAP_BITS) - 1
        self.known: dict[bytes, int | None] = {}

    def _hash(self, word: bytes) -> int | None:
        core = word.decode().strip(_EDGE)
        if len(core) < 3:
            return None
        h = term_hash(core.lower())
        return h if self.bits[h & self.mask] else None

    def terms(self, data: bytes) -> set[int]:
        known, found = self.known, set()
        for w in set(data.split()):
            if w in known:
                h = known[w]
            else:
                h = self._hash(w)
                if len(w) <= LONG_WORD:
                    if len(known) >= HELD_TERMS:
                        known.clear()
                    known[w] = h
            if h is not None:
                found.add(h)
        return found


def term_counts(df: DataFrame, terms: DataFrame, *, text: str = "text") -> DataFrame:
    """``term`` and ``n_term``, the documents with it, for the given hashes (and some that share their bits)."""
    sent = df.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(terms)))
    mask = (1 << BITMAP_BITS) - 1

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        look_up = _Wanted(sent.value)
        held: Counter[int] = Counter()
        for (data,) in it:
            held.update(look_up.terms(data))
            if len(held) >= HELD_TERMS:
                yield from held.items()
                held.clear()
        yield from held.items()

    source = df.select(df[text].cast("string").alias("text")).filter("text is not null")
    counts = map_rows(source, run, "term long, n long", pa.schema([("term", pa.int64()), ("n", pa.int64())]), binary=("text",))
    return counts.groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing(
    df: DataFrame, scanned: DataFrame, *, text: str = "text", support: int = SUPPORT, alpha: float = ALPHA, wide: bool = False
) -> DataFrame:
    """``entity``, ``term``, ``told``, the share of the entity's information that the term gives, from ``alpha`` on,
    and ``spread``, whether it has the support and is in texts too where it isn't beside the entity.

    ``wide``: also entities that values share, and values in fewer than ``support`` documents.
    """
    marked = scanned.filter(F.size("entity") > 0)
    kinds = [("entity", "term"), ("group", "group_term")][: 1 + wide]
    rows = [marked.select(F.explode(F.arrays_zip(e, t)).alias("p")).select(F.col(f"p.{e}").alias("entity"), F.col(f"p.{t}").alias("term")) for e, t in kinds]
    each = [marked.select(F.explode(F.array_distinct(e)).alias("entity"), F.lit(e == "entity").alias("own")) for e, _ in kinds]
    n_of = reduce(DataFrame.unionAll, each).groupBy("entity", "own").agg(F.count("*").alias("n_entity"))
    counts = reduce(DataFrame.unionAll, rows).groupBy("entity", "term").agg(F.count("*").alias("n_both")).join(n_of, "entity")
    enough = F.col("n_both") >= support
    both = cut(counts.filter(enough | (F.col("own") & (F.col("n_entity") < support) if wide else F.lit(False))))
    total = scanned.count()
    known = both.join(term_counts(df, both.select("term"), text=text), "term")
    n = F.lit(float(max(1, total)))
    information = F.log2(n / F.col("n_entity"))
    seen = F.when(enough, F.col("n_both").cast("double")).otherwise(F.col("n_both") - F.lit(DISCOUNT))
    told = F.log2(n * seen / (F.col("n_term").cast("double") * F.col("n_entity"))) / information
    return known.filter(F.col("n_entity") < total).withColumn("told", told).filter(F.col("told") >= alpha).select(
        "entity", "term", "told", (enough & (F.col("n_term") > F.col("n_both"))).alias("spread")
    )


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("told", pa.float64())]))


def term_spans(df: DataFrame, scanned: DataFrame, told: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row with a disclosing term: ``terms``, a sorted array of (start, end, told) of all its occurrences in the text."""
    told = cut(told)
    marked = scanned.filter(F.size("entity") > 0)
    names = ["row_id", "row_hash"]
    mentions = marked.select(*names, F.explode(F.array_union("entity", "group")).alias("entity")).distinct()
    hit = mentions.join(told, "entity").groupBy(*names, "term").agg(F.max("told").alias("told"))
    wanted = hit.groupBy(*names).agg(F.collect_list("term").alias("term"), F.collect_list(F.col("told")).alias("told"))
    source = wanted.select(*names, "term", "told").join(marked.select(*names, "text").dropDuplicates(names), names)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for row_id, row_hash, term, told, t in it:
            if found := occurrences(t, dict(zip(term, told))):
                yield row_id, row_hash, [{"start": a, "end": b, "told": x} for a, b, x in found]

    schema = pa.schema([("row_id", pa.int64()), ("row_hash", pa.int64()), ("terms", _SPAN)])
    beside = map_rows(source, rows, "row_id long, row_hash long, terms array<struct<start:int,end:int,told:double>>", schema)
    spread = cut(told.filter("spread").groupBy("term").agg(F.max("told").alias("told")))
    if spread.isEmpty():
        return beside
    flat = beside.select(*names, F.inline("terms")).unionAll(_everywhere(df, spread, key=key, text=text))
    each = flat.groupBy(*names, "start", "end").agg(F.max("told").alias("told"))
    return each.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("start", "end", "told"))).alias("terms"))


def _everywhere(df: DataFrame, spread: DataFrame, *, key: str, text: str) -> DataFrame:
    """``row_id``, ``row_hash``, ``start``, ``end``, ``told`` of the given terms in all texts. One pass; a bitmap finds candidates."""
    sent = df.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(spread.select("term"))))

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        look_up = _Wanted(sent.value)
        for row_id, row_hash, data in it:
            if found := look_up.terms(data):
                t = data.decode()
                for term, a, b in _outside(list(_terms(t)), base_spans(t)):
                    if term and (h := term_hash(term)) in found:
                        yield row_id, row_hash, h, a, b

    k, t = df[key].cast("long"), df[text].cast("string")
    source = df.select(F.coalesce(k, F.lit(-1)).alias("row_id"), F.xxhash64(k, t).alias("row_hash"), t.alias("text")).filter("text is not null")
    schema = pa.schema([(x, pa.int64()) for x in ("row_id", "row_hash", "term")] + [("start", pa.int32()), ("end", pa.int32())])
    found = map_rows(source, run, "row_id long, row_hash long, term long, start int, end int", schema, binary=("text",))
    return found.join(spread, "term").select("row_id", "row_hash", "start", "end", "told")


def find(df: DataFrame, *, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """Per row: counts and digest of base spans, and ``spans``: base spans and then ``term`` spans."""
    scanned = cut(scan(df, key=key, text=text))
    extra = term_spans(df, scanned, disclosing(df, scanned, text=text, support=support, alpha=alpha, wide=True), key=key, text=text)
    more = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    out = scanned.join(extra, ["row_id", "row_hash"], "left")
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat_ws(",", F.nullif("base", F.lit("")), F.array_join(more, ",")))
    return out.select(
        F.col("key").alias(key), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans")
    )


def redact(text: str, terms: list[tuple[int, int, float]], remove: float = REMOVE) -> str:
    """Base spans become their kind in angle brackets; terms are removed or generalised to ``<term>``.

    Where spans overlap, the whole overlapped stretch takes the kind of the one that starts first.
    """
    spans = sorted([(a, b, f"<{kind}>") for kind, a, b in base_spans(text)] + [(a, b, "" if t >= remove else "<term>") for a, b, t in terms])
    out, done = [], 0
    for a, b, sign in spans:
        if a >= done:
            out += [text[done:a], sign]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sanitised(df: DataFrame, *, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``df`` with its texts redacted, all rows and columns kept. Only rows that may have a disclosing term are shuffled."""
    scanned = cut(scan(df, key=key, text=text))
    told = disclosing(df, scanned, text=text, support=support, alpha=alpha, wide=True)
    extra = cut(term_spans(df, scanned, told, key=key, text=text))
    k, t = df[key].cast("long"), df[text].cast("string")

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, terms: pd.Series) -> pd.Series:
        done = [
            x if x is None else redact(x, [(r["start"], r["end"], r["told"]) for r in (y if y is not None else ())])
            for x, y in zip(texts, terms)
        ]
        return pd.Series(done, dtype=object)

    row_id, row_hash, terms = free_names(df, "row_id", "row_hash", "terms")
    named = df.withColumns({row_id: F.coalesce(k, F.lit(-1)), row_hash: F.xxhash64(k, t)})
    side = extra.select(F.col("row_id").alias(row_id), F.col("row_hash").alias(row_hash), F.col("terms").alias(terms))
    maybe, rest = maybe_in(named, row_hash, extra.select("row_hash"))
    both = maybe.join(side.hint("shuffle_hash"), [row_id, row_hash], "left"), rest.withColumn(terms, F.lit(None).cast(side.schema[terms].dataType))
    columns = [
        (rewrite(named[x].cast("string"), F.col(terms)).alias(x) if x == text else named[x]) for x in df.columns
    ]
    return both[0].select(*columns).unionAll(both[1].select(*columns))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_pii": op8_pii}
ORACLE_SQL: dict[str, str] = {}
