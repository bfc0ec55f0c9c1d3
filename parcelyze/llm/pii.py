"""Personal data: exact patterns as seeds, and bootstrapped contextual extraction of what they miss.

1. One scan of each whole text finds the base spans (email, ip, card, phone) and all other identifier-like candidates: words with a
   digit or an at sign, and runs of two to four words of digits and their punctuation. Each carries its lexical
   patterns: the word before, the two words before, the words on both sides, and its own shape.
2. Base spans are seeds, and so are values assigned to a name such as ``token`` or ``password`` (kind secret). Known negatives are
   candidates that look like a kind and fail its rule: a card without its check digit, an ip part above 255, a phone of too
   few or too many digits. Patterns and instances form a graph with one edge for a distinct (pattern, surface), so copies of
   a document add nothing. Spark scores it in rounds: a pattern's confidence for a kind is the summed score of its
   instances of that kind, over those known (of this kind, another, or none) and a ``doubt`` share of the unknown ones;
   an instance's score is 1 - prod(1 - confidence) over its confident patterns. Instances that reach ``accept`` are known
   from then on: they count towards the support of further patterns.
3. Every candidate whose surface is known becomes a span of that kind. Of overlapping ones the higher score stays, then
   the longer, then the first.

Only step 1 reads texts; the graph is aggregates and equi-joins over small written tables. Nothing is collected.

Defined results. Null or empty text: no spans. Rows that repeat, or repeat an id, are rows of their own. A null id is
scanned as any other. Very long texts are scanned whole, in time linear in their length; long words and surfaces stand in
the graph by hashes of all of them. An added span never overlaps a base span. Ties between kinds go to the first in the
order email, ip, card, phone, secret. Offsets are code points, end exclusive. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, small_batches, written

#: The base kinds, and one that only the method finds.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_REST = re.compile(r"\S*")
_NUMBER = re.compile(r"[0-9+().\-]+")
_ASSIGNED = re.compile(r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)\s?[:=]\s?[\"']?$", re.IGNORECASE)
#: Words of digits that may be one number.
MOST_WORDS = 4
_LEAST = 4
_SECRET = 16
_QUOTED = 64


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters before an at sign, after the last match, then a dotted domain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not _ANY.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 3 or len(p.lstrip("0")) == 3 and p.lstrip("0") <= "255" for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def shape(token: str) -> str:
    """Letters a, digits 9; lengths of digit runs stay where there are no letters, that of hexadecimal strings too."""
    if len(token) >= _SECRET and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token) and not token.isdigit():
        return f"h{{{len(token)}}}"
    if any(c.isalpha() for c in token):
        return re.sub(r"(?:a9){2,}", "(a9)+", re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", token)))
    return re.sub(r"[0-9]+", lambda m: f"9{{{len(m[0])}}}", token)


def denied(surface: str) -> int:
    """The kind that a surface looks like without being one, or -1."""
    digits = sum(c.isdigit() for c in surface)
    if surface[0] == "+":
        return -1 if 9 <= digits <= 15 else 3
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", surface):
        return 1
    if 13 <= digits <= 19 and _CARD.fullmatch(surface):
        return -1 if luhn(surface.replace(" ", "").replace("-", "")) else 2
    return -1


def _named(text: str) -> str:
    """A text as it is, or a hash of all of it if it is long."""
    return text if len(text) <= _QUOTED else "#" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _words_before(text: str, at: int) -> list[str]:
    """The last two words before a place."""
    width = 48
    while True:
        words = text[max(0, at - width) : at].split()
        if len(words) > 2 or width >= at:
            return [_named(w.lower()) for w in words[-2:]]
        width *= 4


def _word_after(text: str, at: int) -> str:
    width = 32
    while True:
        words = text[at : at + width].split(None, 1)
        if len(words) > 1 or at + width >= len(text):
            return _named(words[0].lower()) if words else "$"
        width *= 4


def _marked_words(text: str) -> list[tuple[int, int]]:
    """The spans of words with a digit or an at sign."""
    out, last = [], 0
    while m := _ANY.search(text, last):
        lead = text[last : m.start()]
        start = m.start() if not lead or lead[-1].isspace() else m.start() - len(lead.rsplit(None, 1)[-1])
        last = _REST.match(text, m.end()).end()
        out.append((start, last))
    return out


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without quotes and stops about it; a closing bracket stays if its opening one is inside."""
    while a < b and text[a] in "\"'[{<,;:=|":
        a += 1
    while b > a and text[b - 1] in "\"'])}>,;:=.!?|$*#&%" and not (text[b - 1] == ")" and "(" in text[a:b]):
        b -= 1
    return a, b


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str], int]]:
    """(kind or -1, start, end, surface, patterns, denied kind or -1) of base spans and of candidates outside them."""
    if not _ANY.search(text):
        return []
    taken = sorted((a, b) for _, a, b in base)
    words, i = [], 0  # what base spans leave of the marked words
    for a, b in _marked_words(text):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        k = i
        while a < b:
            stop = max(a, taken[k][0]) if k < len(taken) and taken[k][0] < b else b
            if stop > a and _ANY.search(text, a, stop):
                words.append((a, stop))
            if stop == b:
                break
            a = taken[k][1]
            k += 1
    found = [(k, a, b, -1) for k, a, b in base]
    for n, (a, b) in enumerate(words):
        spans = [(a, b)]
        if _NUMBER.fullmatch(text, a, b):
            for m in range(n + 1, min(n + MOST_WORDS, len(words))):
                if words[m][0] != words[m - 1][1] + 1 or text[words[m - 1][1]] != " " or not _NUMBER.fullmatch(text, *words[m]):
                    break
                spans.append((a, words[m][1]))
        for x, y in spans:
            x, y = _trimmed(text, x, y)
            if y - x >= _LEAST and _ANY.search(text, x, y):
                kind, no = -1, denied(text[x:y])
                if y - x >= _SECRET and _ASSIGNED.search(text, max(0, x - 24), x) and any(c.isalpha() for c in text[x:y]):
                    kind = BASE
                found.append((kind, x, y, no))
    out = []
    for k, a, b, no in sorted(set(found), key=lambda f: (f[1], f[2], f[0])):
        before = _words_before(text, a)
        left = before[-1] if before else "^"
        pair = " ".join(before) if len(before) == 2 else "^ " + left
        surface = text[a:b]
        out.append((k, a, b, _named(surface), ["L " + left, "LL " + pair, "LR " + left + " _ " + _word_after(text, b), "S " + _named(shape(surface))], no))
    return out


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("surface", pa.string()), ("patterns", pa.list_(pa.string())), ("denied", pa.int32())])
_FOUND = "array<struct<kind:int,start:long,end:long,surface:string,patterns:array<string>,denied:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("kind", "start", "end", "surface", "patterns", "denied")
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            out.append([dict(zip(names, c)) for c in candidates(text or "", base)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_SPAN))], ["doc_id", "found"])


def _overlap(x, y):
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rounds: int = 3, support: int = 5, confident: float = 0.8, accept: float = 0.9, doubt: float = 0.1) -> DataFrame:
    """(doc_id, base, added) for each row: arrays of (kind, start, end), kind an index into KINDS, sorted.

    support: known distinct surfaces that a pattern needs; confident: its least confidence; accept: an instance's least
    score; doubt: the share of an unknown instance that counts against a pattern.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_scan, f"doc_id long, found {_FOUND}")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "spans")  # written once, so row numbers hold
    each = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("c")).select("row", "c.*")
    seed = F.min(F.when(F.col("kind") >= 0, F.col("kind")))
    surfaces = written(each.groupBy("surface").agg(seed.alias("seed"), F.max("denied").alias("denied")), "surfaces")
    edges = written(each.select("surface", F.explode("patterns").alias("pattern")).distinct().join(surfaces, "surface"), "edges")
    kinds = range(len(KINDS))
    best, old = None, []
    for _ in range(rounds):
        # One aggregate holds all that is known of a pattern: by kind, the summed score and number of its instances, and of those denied.
        kind, score, marked = F.col("seed"), F.when(F.col("seed").isNotNull(), F.lit(1.0)), edges
        if best is not None:
            marked = edges.join(best.withColumnsRenamed({"kind": "later", "score": "rated"}), "surface", "left")
            kind, score = F.coalesce("seed", "later"), F.coalesce(score, F.col("rated"))
        marked = marked.withColumns({"kind": kind, "score": score})
        of = lambda k: F.struct(F.lit(k).alias("kind"), F.sum(F.when(F.col("kind") == k, F.col("score"))).alias("yes"), F.count_if(F.col("kind") == k).alias("n"), F.count_if(F.col("denied") == k).alias("no"))
        open_ = F.count_if(F.col("kind").isNull() & (F.col("denied") < 0))
        stats = marked.groupBy("pattern").agg(F.sum("score").alias("sure"), open_.alias("open"), F.array(*map(of, kinds)).alias("each"))
        good = stats.select("pattern", "sure", "open", F.inline("each")).where(F.col("n") >= support)
        good = good.withColumn("confidence", F.col("yes") / (F.col("sure") + F.col("no") + F.col("open") * doubt)).where(F.col("confidence") >= confident)
        good = written(good.select("pattern", "kind", "confidence"), "patterns")
        miss = F.sum(F.log(1.0 - F.least(F.col("confidence"), F.lit(0.999))))
        scored = edges.where("seed is null").join(good, "pattern").where("denied <> kind")
        scored = scored.groupBy("surface", "kind").agg((1.0 - F.exp(miss)).alias("score")).where(F.col("score") >= accept)
        best = written(scored.groupBy("surface").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.least(F.max("score"), F.lit(0.9999)).alias("score")), "best")
        old += [good, best]
    known = surfaces.where("seed is not null").select("surface", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    known = known if best is None else known.unionByName(best)
    span = F.struct((-F.col("score")).alias("low"), (F.col("start") - F.col("end")).alias("short"), "start", "end", F.col("as").alias("kind"))
    added = each.where(f"kind < 0 or kind >= {BASE}").drop("kind").join(known.withColumnRenamed("kind", "as"), "surface").where("as <> denied").groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    # The best first; what overlaps a better one goes. A row's candidates are few.
    none = F.filter("spans", lambda x: F.lit(False))
    kept = F.aggregate("spans", none, lambda acc, x: F.when(F.exists(acc, lambda y: _overlap(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    plain = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    added = written(added.select("row", F.array_sort(F.transform(kept, plain)).alias("added")), "added")
    drop_written(*old, edges, surfaces)
    base = F.transform(F.filter("found", lambda c: (c["kind"] >= 0) & (c["kind"] < BASE)), plain)
    empty = F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint>>)")
    return rows.select("row", "doc_id", F.array_sort(base).alias("base")).join(added, "row", "left").select("doc_id", "base", F.coalesce("added", empty).alias("added"))


def pii_digest(found: DataFrame) -> DataFrame:
    """The thin query's columns. Counts are of base spans; ``spans`` names all."""
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"].cast("string"), c["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{x}") for k, x in enumerate(KINDS[:BASE])]
    both = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"), said(both).alias("spans"), F.size("added").cast("long").alias("n_added"))
