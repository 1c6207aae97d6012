"""Column expressions: normalising, splitting, hashing. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and most hits a search returns.
LIMITS = (1, 50)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """Without white space at either end, by Unicode's notion of it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def nonblank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences(text: Column, pattern: str = r"(?U)(?<=[.!?])\s+|\n") -> Column:
    """Stripped nonempty sentences: cut after . ! ? and at line ends."""
    return nonblank(F.split(text, pattern))


def paragraphs(text: Column) -> Column:
    """Stripped nonempty parts between blank lines."""
    return nonblank(F.split(text, r"(?U)\n\s*\n+"))


def is_heading(text: Column) -> Column:
    """A first line with #s, a number and a dot, or at least three letters, all of them upper-case."""
    line = F.split(strip(text), "\n")[0]
    letters = F.regexp_replace(line, r"\P{L}", "")
    return line.rlike(r"(?U)^#{1,6}\s+\S") | line.rlike(r"(?U)^\d+\.\s+\S") | letters.rlike(r"^\p{Lu}{3,}$")


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.when(squeeze(text) == "", 0).otherwise(F.size(F.split(squeeze(text), " ")))


def sparse_index(keyword: Column) -> Column:
    """A keyword's place in a sparse vector of 2**20: the last 20 bits of its MD5."""
    return F.conv(F.right(F.md5(F.lower(keyword)), F.lit(5)), 16, 10).cast("int")


def path_id(path: Column) -> Column:
    """A document's id of the first generation: MD5 of its path."""
    return F.md5(path)


def percent_encoded(text: Column) -> Column:
    """A value for a URL's query: as `url_encode`, but a space is %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def point_id(chunk_id: Column) -> Column:
    """The low 63 bits of the MD5 of a chunk's id."""
    low = F.right(F.md5(chunk_id), F.lit(16))
    top = F.conv(F.left(low, F.lit(1)), 16, 10).cast("int").bitwiseAND(7)
    return F.conv(F.concat(F.hex(top), F.right(low, F.lit(15))), 16, 10).cast("long")


def uuid5(name: Column, namespace_hex: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """The version 5 UUID of a name in a namespace (default: URLs)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def content_hash(content: Column, length: Column) -> Column:
    """SHA-1 of the first MiB and the decimal size."""
    return F.sha1(F.concat(F.substring(content, 1, 1 << 20), F.encode(length.cast("string"), "utf-8")))


def stamp_hash(modified: Column, length: Column) -> Column:
    """Modification time in seconds to the millisecond, and size."""
    return F.concat(F.format_string("%.3f", modified.cast("double")), F.lit("_"), length)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    """A vector scaled to length one."""
    return let(norm(a), lambda n: F.transform(a, lambda x: x / n))


def shown_keywords(keywords: list[str] | Column, content: Column) -> Column:
    """Query keywords that the content holds, or the first three."""
    all_ = keywords if isinstance(keywords, Column) else F.array(*map(F.lit, keywords))
    found = F.filter(all_, lambda k: F.contains(F.lower(content), F.lower(k)))
    return F.when(F.size(found) == 0, F.slice(all_, 1, 3)).otherwise(found)


def excerpt(content: Column, keywords: list[str] | Column, most: int = 300) -> Column:
    """The sentences with the most query keywords, in that order, up to `most` characters.

    Sentences are added until the next would not fit or half is reached; if none fits, the first of the text is cut.
    """

    def hits(s: Column) -> Column:
        if isinstance(keywords, Column):
            return F.size(F.filter(keywords, lambda k: F.contains(F.lower(s), F.lower(k))))
        wanted = [F.lit(k.lower()) for k in keywords]
        return sum((F.contains(F.lower(s), k).cast("int") for k in wanted), F.lit(0))

    def gather(ss: Column) -> Column:
        ranked = F.array_sort(F.transform(ss, lambda s, i: F.struct((-hits(s)).alias("h"), i.alias("i"), s.alias("s"))))
        start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

        def add(state: Column, s: Column) -> Column:
            longer = F.when(state["text"] == "", s["s"]).otherwise(F.concat(state["text"], F.lit(" "), s["s"]))
            fits = ~state["full"] & (F.char_length(longer) <= most)
            return F.struct(F.when(fits, longer).otherwise(state["text"]).alias("text"), (~fits | (F.char_length(longer) >= most // 2)).alias("full"))

        return F.aggregate(ranked, start, add)["text"]

    def cut(ss: Column) -> Column:
        best = let(gather(ss), lambda e: F.when(e == "", F.get(ss, F.lit(0))).otherwise(e))
        whole = let(best, lambda e: F.when(F.char_length(e) > most, F.concat(F.regexp_replace(F.substring(e, 1, most), r"(?U)\s+\z", ""), F.lit("…"))).otherwise(e))
        return F.when(F.size(ss) == 0, strip(F.substring(content, 1, most))).otherwise(whole)

    return let(sentences(content), cut)
