"""Small fixtures and plain-Python versions that the operators of `llm` are held against."""

import hashlib
import random
import re
import zlib

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def low_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def corpus(seed=0, n=60, vocabulary=400, size=120):
    """Texts with exact copies, near copies, shared passages, repeated lines, nulls, empty and very long ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéñßz0") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)]

    def prose(k):
        return " ".join(rng.choice(words) + rng.choice(["", "", ",", ".", "\n", "!"]) for _ in range(k))

    texts = [prose(rng.randint(1, size)) for _ in range(n)]
    passage, base = prose(70), prose(size)
    for i in range(0, n, 5):
        texts[i] = prose(rng.randint(0, 30)) + " " + passage + " " + prose(rng.randint(0, 30))
    for i in range(1, n, 7):
        parts = base.split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        texts[i] = " ".join(parts)
    texts[3], texts[8] = base, base
    texts[9] = "x " * 200
    texts[10] = "x y z " * 100
    texts[11], texts[12], texts[13] = None, "", " \n\t "
    texts[14] = prose(6000)
    texts[16] = "ABC Def " + base.upper()
    texts[17] = texts[14][:9000]
    texts[18] = "a" * 350
    rows = [(i * 3, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, base, None, None, None))  # no id
    rng.shuffle(rows)
    return rows


def frame(spark, rows, schema=SCHEMA):
    """With extra columns whose names clash with what the operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in EXTRA}).repartition(5)


EXTRA = ["text_key", "h", "chunk", "n_words", "spans", "score", "key", "band", "label", "rank", "word", "codes", "slot", "item", "_own", "_n", "_lost", "_again", "_id", "_key", "_quality"]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
