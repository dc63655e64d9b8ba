"""Language identification by cross-parsing entropy.

For each language the labelled texts form one string, whose suffix automaton
accepts every stretch of it. A text is parsed greedily into phrases, each the
longest match from where the last ended; a phrase costs log2 of the string's
length, as a pointer into it would. The language that needs the fewest bits a
letter wins. Letters are lower-cased; each run of other characters is one
blank. Long texts are parsed whole, in blocks of BLOCK symbols.

Learning reads a bounded sample: ``letters`` characters in all, shared evenly by
the languages, from documents in the order of a hash of their id, at most
``docs_per_lang`` for each language. Documents are taken whole; of one that is
longer than a quarter of its language's share a stretch of that length from a place
given by the hash. The choice is made in Spark; the driver gets the chosen characters and no
others. Prediction never sees lang, source or doc_id.

Every letter of the sample has a symbol of its own, of two bytes, and letters that
the sample lacks share one. An automaton's transitions lie in one array by row
displacement: a state has a place, its transition by a symbol stands that symbol
further, with the state it belongs to, so that an automaton takes a few bytes for
each transition, whatever the alphabet.

Defined results: null texts and texts without a letter are ``und`` with score 0;
with nothing to learn from every text is ``und``; on a tie the first language by
code point wins; repeated rows pass, and so do extra columns, but for those named
lang_pred, score and bits, which are replaced; an empty table gives no row.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK, CHUNK = 1024, 1_500_000


def automaton(symbols) -> tuple[list[int], list[int], list[int], int]:
    """Transitions (from, symbol, to) of the suffix automaton, and its number of states."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    src, sym, dst = [], [], []
    for s, m in enumerate(move):
        for c, t in m.items():
            src.append(s)
            sym.append(c)
            dst.append(t)
    return src, sym, dst, len(move)


def displaced(src, sym, dst, states: int):
    """Places of the states, and the array in which (owner, next state) of a transition stand at place + symbol; unused entries have owner -1."""
    import numpy as np

    order = np.lexsort((sym, src))
    src, sym, dst = src[order], sym[order], dst[order]
    first = np.searchsorted(src, np.arange(states + 1))
    degree = np.diff(first)
    width, place = int(sym.max(initial=0)) + 1, np.zeros(states, np.int32)
    owner, to = np.full(2 * len(src) + 2 * width, -1, np.int32), np.zeros(2 * len(src) + 2 * width, np.int32)
    several = np.flatnonzero(degree > 1)
    begin, before = 0, 0
    for s in several[np.argsort(-degree[several], kind="stable")].tolist():
        a, b = int(first[s]), int(first[s + 1])
        own = sym[a:b]
        # Where states of as many transitions have found no room, this one hardly does.
        at = begin = max(0, begin - 256) if b - a == before else 0
        before = b - a
        while True:
            while at + 256 + width > len(owner):
                owner, to = (np.concatenate([x, np.full(len(x), fill, np.int32)]) for x, fill in ((owner, -1), (to, 0)))
            free = (owner[at + own[:, None] + np.arange(256)] < 0).all(axis=0)
            k = int(free.argmax())
            if free[k]:
                at += k
                break
            at += 256
        place[s], owner[at + own], to[at + own], begin = at, s, dst[a:b], at
    one = np.flatnonzero(degree == 1)  # these fill the gaps
    edge = first[one]
    while True:
        gaps = np.flatnonzero(owner[width:] < 0)[: len(one)] + width
        if len(gaps) == len(one):
            break
        owner, to = (np.concatenate([x, np.full(len(x), fill, np.int32)]) for x, fill in ((owner, -1), (to, 0)))
    place[one], owner[gaps], to[gaps] = gaps - sym[edge], one, dst[edge]
    size = int(np.flatnonzero(owner >= 0).max(initial=0)) + 1 + width
    return place, owner[:size].copy(), to[:size].copy()


def letter_table(alphabet: str):
    """Symbol of each code point: 0 for what is no letter, 1 for an unknown letter."""
    import numpy as np

    table = np.fromiter((1 if chr(c).isalpha() else 0 for c in range(0x110000)), dtype=np.uint16, count=0x110000)
    for k, c in enumerate(alphabet[: 0xFFFE]):
        table[ord(c)] = k + 2
    return table


def symbols_of(texts: list[str], table):
    """Symbols of all texts in a row, runs of blanks as one, and the length of each."""
    import numpy as np

    raw = "\0".join(t.lower().replace("\0", " ") for t in texts) + "\0"
    points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = table[points]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    ends = np.flatnonzero(points == 0)
    count = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(s != 0)])
    starts = np.concatenate([[0], ends[:-1] + 1])
    return s[keep], count[ends] - count[starts], letters[ends] - letters[starts], count[starts]


def sample(labelled: DataFrame, docs_per_lang: int, letters: int) -> dict[str, list[str]]:
    """Texts to learn from, by language: at most letters characters in all."""
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text_hash")
    few = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("text_hash"), F.length("text").cast("long").alias("n"))
    few = common.staged(few.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= docs_per_lang).distinct(), "language-sample")
    share = max(1, letters // max(1, few.select("lang").distinct().count()))
    sized = few.withColumn("size", F.least("n", F.lit(max(1, share // 4))))
    sized = sized.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    chosen = sized.where(F.col("before") + F.col("size") <= share).select("lang", "doc_id", "text_hash", "size", "r", (F.pmod("h", F.col("n") - F.col("size") + 1) + 1).cast("int").alias("at"))
    own = rows.select(F.col("lang").alias("_l"), F.col("doc_id").alias("_d"), "text").withColumn("_t", F.xxhash64("text"))
    hit = (F.col("lang") == F.col("_l")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))
    got = own.join(F.broadcast(chosen), hit).groupBy("lang", "r").agg(F.min(F.substr("text", F.col("at"), F.col("size").cast("int"))).alias("text")).collect()
    common.drop(few)
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.r)):
        out.setdefault(r.lang, []).append(r.text)
    return out


def learn(labelled: DataFrame, docs_per_lang: int = 60, letters: int = 100_000) -> dict:
    """labelled: (doc_id, text, lang). The model: alphabet, and packed transitions of each language."""
    import numpy as np

    texts = {lang: "\n".join(own) for lang, own in sample(labelled, docs_per_lang, letters).items()}
    alphabet = "".join(sorted({c for t in texts.values() for c in t.lower() if c.isalpha()}))
    table, models = letter_table(alphabet), []
    for lang, text in texts.items():
        s = symbols_of([text], table)[0]
        src, sym, dst, n = automaton(s.tolist())
        place, owner, to = displaced(np.array(src, np.int32), np.array(sym, np.int32), np.array(dst, np.int32), n)
        packed = zlib.compress(place.tobytes() + owner.tobytes() + to.tobytes(), 1)
        models.append((lang, packed, n, len(owner), len(s)))
    return {"alphabet": alphabet, "models": models}


class Parser:
    """Bits a letter for each language, for many texts at once."""

    def __init__(self, model: dict):
        import numpy as np

        self.table = letter_table(model["alphabet"])
        self.langs = [m[0] for m in model["models"]]
        self.tables = []
        for _, packed, states, size, length in model["models"]:
            raw = zlib.decompress(packed)
            place = np.frombuffer(raw, np.int32, states)
            owner, to = np.frombuffer(raw, np.int32, 2 * size, 4 * states).reshape(2, size)
            # From the root: the next state for each symbol, 0 for one that the language lacks.
            width = min(int(self.table.max()) + 1, size - int(place[0]))
            root = np.zeros(int(self.table.max()) + 1, np.int32)
            own = owner[place[0] : place[0] + width] == 0
            root[:width][own] = to[place[0] : place[0] + width][own]
            self.tables.append((place, owner, to, root, math.log2(length + 2)))

    def phrases(self, s, starts, sizes):
        """Number of phrases of each text in each language."""
        import numpy as np

        blocks = -(-sizes // BLOCK)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[doc] + k * BLOCK
        size = np.minimum(sizes[doc] - k * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        doc, begin, size = doc[order], begin[order], size[order]
        steps = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(steps), side="left")
        out = np.zeros((len(self.tables), len(sizes)))
        lanes = [s[begin[:a] + t] for t, a in enumerate(active.tolist())]
        for i, (place, owner, to, root, _) in enumerate(self.tables):
            state, count, last = np.zeros(len(doc), np.int32), np.zeros(len(doc), np.int32), len(owner) - 1
            for a, c in zip(active.tolist(), lanes):
                was = state[:a]
                at = np.minimum(place[was] + c, last)
                # Without a match the phrase ends and a new one starts at the root; a symbol that the language lacks is a phrase of its own.
                lost = owner[at] != was
                now = to[at]
                again = np.flatnonzero(lost)
                if len(again):
                    new = root[c[again]]
                    count[again] += (was[again] != 0).astype(np.int32) + (new == 0)
                    now[again] = new
                state[:a] = now
            count += state != 0
            out[i] = np.bincount(doc, count, len(sizes))
        return out

    def predict(self, texts: list[str | None]):
        """(language, score, fewest bits a letter) for each text."""
        import numpy as np

        s, sizes, letters, starts = symbols_of([t or "" for t in texts], self.table)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        cost = self.phrases(s, starts, sizes) * np.array([[t[-1]] for t in self.tables]) / np.maximum(sizes, 1)
        best = cost.argmin(axis=0)
        odds = np.exp2(-2 * (cost - cost.min(axis=0)))
        score = np.where(letters > 0, 1 / odds.sum(axis=0), 0.0)
        return [self.langs[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist())], score, np.where(letters > 0, cost.min(axis=0), 0.0)


def identify(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """df with lang_pred, score and bits (fewest bits a letter)."""
    spark = df.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by learn()'s letters
    key = f"{zlib.crc32(model['alphabet'].encode())}-{sum(zlib.crc32(m[1]) for m in model['models'])}"
    keep = [c for c in df.columns if c not in ("lang_pred", "score", "bits")]

    def run(batches):
        import pyarrow as pa

        parser = common.resident(f"language {key}", lambda: Parser(shared.value))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            names, scores, bits = [], [], []
            at = 0
            while at < len(texts):  # CHUNK characters at a time, but whole texts
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
                    size += len(texts[end] or "")
                    end += 1
                a, b, c = parser.predict(texts[at:end])
                names += a
                scores += b.tolist()
                bits += c.tolist()
                at = end
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=[*keep, "lang_pred", "score", "bits"])

    schema = df.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits")).schema
    return df.select(*keep).mapInArrow(run, schema)


def held_out(doc_id: str):
    """Documents of which nothing is learnt."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0
