"""Personal data: patterns, and terms that reveal a protected entity.

Base spans follow four patterns (see base_spans). Their values are the protected
entities. Corpus co-occurrence then estimates how strongly a term reveals one:
of the distinct contexts (WINDOW words on each side of a mention) that hold the
term, the share in which the entity is the same, and against all documents with
the term the pointwise mutual information in bits. Terms with at least SUPPORT
distinct contexts, a share of SHARE and BITS bits are spans of kind ``term`` in
every document. sanitise() replaces base spans by their kind, generalises such
terms to ``[term]``, and removes those above REMOVE of share.

Texts are read three times: for mentions, for the documents that hold a term, and
for the result, which comes row by row from the texts, without a join. Terms beyond
TERMS_AT_ONCE are joined to the words of each document instead of travelling with
the tasks; the result is the same.

Contexts are told apart by their text, and so are documents (a 128-bit hash), both
where they hold a term and in all: copies of one document count once.

Defined results: null texts have no spans and stay null when cleaned; empty texts
have no spans; every row gives one row, with its own spans, whatever doc_ids repeat
or are null; extra columns are ignored by find() and pass sanitise(); an empty table
gives no row. Of a span that begins inside another only the first is replaced.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
WINDOW, SUPPORT, SHARE, BITS, REMOVE = 5, 3, 0.6, 6.0, 0.9
#: Revealing terms up to this number travel with the tasks; more are joined.
TERMS_AT_ONCE = 100_000

_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digit = re.compile("[0-9]").search
_word = re.compile(r"[^\W\d_]{3,}").finditer


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; every search is linear in the text."""
    if not text:
        return []
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _digit(text):
        if text.count(".") > 2:
            out += [(*m.span(), 1) for m in _ip(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _card(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _phone(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def _contexts(text: str, spans: list[tuple[int, int, str]], window: int) -> list[tuple[int, int, str]]:
    """(entity, context, term): words of letters near each mention that no span covers."""
    import xxhash

    out, merged = [], []
    for a, b, _ in spans:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    starts = [m[0] for m in merged]

    def free(m) -> bool:
        k = bisect.bisect_left(starts, m.end()) - 1
        return k < 0 or merged[k][1] <= m.start()

    words = [m for m in _word(text) if free(m)] if spans else []
    first, last = [m.start() for m in words], [m.end() for m in words]
    for a, b, kind in spans:
        value = re.sub(r"[\x20().-]", "", text[a:b]).lower() if kind != "email" else text[a:b].lower()
        entity = xxhash.xxh64_intdigest(f"{kind}:{value}") - (1 << 63)
        i, j = bisect.bisect_right(last, a), bisect.bisect_left(first, b)
        before, after = ([m[0].lower() for m in near] for near in (words[max(0, i - window) : i], words[j : j + window]))
        context = xxhash.xxh64_intdigest(" ".join(before) + "|" + " ".join(after)) - (1 << 63)
        out += [(entity, context, t) for t in sorted({*before, *after})]
    return out


CONTEXTS = "h1 bigint, h2 bigint, contexts array<struct<entity:bigint,context:bigint,term:string>>"


def _text_hash(text: str | None) -> tuple[int | None, int | None]:
    """128 bits that tell texts apart, as two integers; null for null."""
    import xxhash

    if text is None:
        return None, None
    h = xxhash.xxh3_128_intdigest(text)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _hashes(pa, found: list[tuple]) -> list:
    return [pa.array([h[k] for h in found], pa.int64()) for k in (0, 1)]


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The hash of every text and the contexts of its mentions; see CONTEXTS."""
    common.ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.string())]))
        for batch in batches:
            hashes, contexts = [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                hashes.append(_text_hash(text))
                contexts.append([{"entity": e, "context": c, "term": t} for e, c, t in _contexts(text, spans, window)] if spans else [])
            yield pa.RecordBatch.from_arrays([*_hashes(pa, hashes), pa.array(contexts, kind)], names=["h1", "h2", "contexts"])

    return docs.select("text").mapInArrow(run, CONTEXTS)


def _holding(docs: DataFrame, terms: DataFrame, few: set[str] | None) -> DataFrame:
    """(term, docs): distinct texts that hold each of the terms."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hashes, held = [], []
            for text in batch.column(0).to_pylist():
                found = {m[0].lower() for m in _word(text or "")}
                if few is not None:
                    found &= few
                if found:
                    hashes.append(_text_hash(text))
                    held.append(sorted(found))
            yield pa.RecordBatch.from_arrays([*_hashes(pa, hashes), pa.array(held, pa.list_(pa.string()))], names=["h1", "h2", "terms"])

    # Copies hold the same terms: any row of a hash stands for all.
    texts = docs.select("text").mapInArrow(run, "h1 bigint, h2 bigint, terms array<string>").dropDuplicates(["h1", "h2"])
    counted = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("docs"))
    return counted if few is not None else counted.join(terms.select("term"), "term", "left_semi")


def revealing(docs: DataFrame, scanned: DataFrame, support: int = SUPPORT, share: float = SHARE, bits: float = BITS, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """(term, share, bits): terms that reveal one entity, staged."""
    seen = scanned.select(F.explode("contexts").alias("x")).select("x.entity", "x.context", "x.term").distinct()
    pairs = seen.groupBy("term", "entity").agg(F.count("*").alias("n"))
    best = pairs.groupBy("term").agg(F.max(F.struct("n", "entity")).alias("top"), F.sum("n").alias("all"))
    strong = best.where((F.col("top.n") >= support) & (F.col("top.n") >= share * F.col("all"))).select("term", F.col("top.entity").alias("entity"), F.col("top.n").alias("n"), "all")
    strong = common.staged(strong, "strong-terms")
    known = strong.count()
    if not known:
        return common.staged(strong.select("term", F.lit(1.0).alias("share"), F.lit(0.0).alias("bits")), "terms")
    few = {r[0] for r in strong.select("term").collect()} if known <= at_once else None
    held = _holding(docs, strong, few)
    mentions = seen.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("mentions"))
    total = scanned.where(F.col("h1").isNotNull()).select("h1", "h2").distinct().count()
    pmi = F.log2(F.col("n") * F.lit(float(total)) / (F.greatest("docs", "n") * F.col("mentions")))
    told = F.col("n") / F.greatest("docs", "all", "n")
    out = strong.join(held, "term").join(mentions, "entity").select("term", told.alias("share"), pmi.alias("bits"))
    out = common.staged(out.where((F.col("share") >= share) & (F.col("bits") >= bits)), "terms")
    common.drop(strong)
    return out


def with_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """docs with ``_pii_terms``, those of the terms that a text holds, for any number of terms: words of documents join terms."""
    keyed = common.staged(docs.withColumn("_pii_row", F.monotonically_increasing_id()), "rows")

    def words_of(batches):
        import pyarrow as pa

        for batch in batches:
            rows, words = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {m[0].lower() for m in _word(text or "")}
                rows += [row] * len(found)
                words += found
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.string())], names=["_pii_row", "term"])

    held = keyed.select("_pii_row", "text").mapInArrow(words_of, "_pii_row bigint, term string").join(terms.select("term", "share"), "term")
    held = held.groupBy("_pii_row").agg(F.collect_list(F.struct("term", "share")).alias("_pii_terms"))
    return keyed.join(held, "_pii_row", "left").drop("_pii_row")


class Marker:
    """Spans and cleaned forms of texts, given terms and how strongly each reveals."""

    def __init__(self, terms: dict[str, float], remove: float = REMOVE):
        self.terms, self.remove = terms, remove

    def spans(self, text: str | None, terms: dict[str, float] | None = None) -> list[tuple[int, int, str]]:
        """Base spans and those of revealing terms that no base span covers, by start, then kind as listed."""
        terms = self.terms if terms is None else terms
        base = base_spans(text)
        if not text or not terms or terms.keys().isdisjoint(words := [m[0].lower() for m in _word(text)]):
            return base
        more = [(m.start(), m.end(), "term") for m, w in zip(_word(text), words) if w in terms]
        ends, top = [], 0
        for _, b, _ in base:
            top = max(top, b)
            ends.append(top)
        starts = [a for a, _, _ in base]
        for a, b, k in more:
            at = bisect.bisect_left(starts, b) - 1  # the base spans up to here begin before the word ends
            if at < 0 or ends[at] <= a:
                base.append((a, b, k))
        return sorted(base, key=lambda s: (s[0], (*KINDS, "term").index(s[2])))

    def clean(self, text: str | None, spans: list[tuple[int, int, str]], terms: dict[str, float] | None = None) -> str | None:
        """The text with spans replaced by their kind in brackets, the most revealing terms by nothing."""
        if text is None:
            return None
        terms = self.terms if terms is None else terms
        out, done = [], 0
        for a, b, k in spans:
            if a >= done:
                gone = k == "term" and terms[text[a:b].lower()] > self.remove
                out += [text[done:a], "" if gone else f"[{k}]"]
            done = max(done, b)
        return "".join(out) + text[done:]


def _known(docs: DataFrame, terms: DataFrame, at_once: int) -> tuple[DataFrame, dict[str, float] | None]:
    """docs and all terms, or, where there are too many of them to travel with tasks, docs with their own and None."""
    known = terms.count()
    if known <= at_once:
        return docs, {r.term: r.share for r in terms.select("term", "share").collect()}
    return with_terms(docs, terms), None


MARKED = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string, clean_sha256 string"


def mark(docs: DataFrame, terms: DataFrame, remove: float = REMOVE, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """One row for each row of docs, see MARKED; terms comes from revealing()."""
    rows, few = _known(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), terms, at_once)
    names = [x.split()[0] for x in MARKED.split(", ")]

    def run(batches):
        import hashlib

        import pyarrow as pa

        marker = Marker(few or {}, remove)
        told = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        for batch in batches:
            own = batch.column(2).to_pylist() if few is None else [None] * len(batch)
            counts, texts = [[] for _ in KINDS], ([], [], [])
            for text, held in zip(batch.column(1).to_pylist(), own):
                held = few if few is not None else {t["term"]: t["share"] for t in held or ()}
                spans = marker.spans(text, held)
                base = [s for s in spans if s[2] != "term"]
                for kind, c in zip(KINDS, counts):
                    c.append(sum(s[2] == kind for s in base))
                clean = marker.clean(text, spans, held)
                for to, x in zip(texts, (told(base), told(spans), None if clean is None else hashlib.sha256(clean.encode("utf-8", "surrogatepass")).hexdigest())):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(t, pa.string()) for t in texts)], names=names)

    return rows.mapInArrow(run, MARKED)


def sanitise(docs: DataFrame, terms: DataFrame, remove: float = REMOVE, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """docs with base spans replaced by their kind, revealing terms generalised, and the most revealing ones removed; terms comes from revealing()."""
    common.ship(docs.sparkSession)
    rows, few = _known(docs, terms, at_once)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        import pyarrow as pa

        marker = Marker(few or {}, remove)
        for batch in batches:
            own = batch.column(len(names)).to_pylist() if few is None else [None] * len(batch)
            texts = []
            for text, held in zip(batch.column(at).to_pylist(), own):
                held = few if few is not None else {t["term"]: t["share"] for t in held or ()}
                texts.append(marker.clean(text, marker.spans(text, held), held))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names=names)

    return rows.mapInArrow(run, docs.schema)


def find(docs: DataFrame) -> DataFrame:
    """Counts of base spans, base, spans (comma-joined kind:start:end) and the cleaned text's hash for each row; see MARKED."""
    scanned = common.staged(scan(docs), "contexts")
    terms = revealing(docs, scanned)
    common.drop(scanned)
    return mark(docs, terms)
