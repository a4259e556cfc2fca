"""Small tables with every awkward case."""
import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()), T.StructField("kept", T.IntegerType()), T.StructField("size", T.StringType()),
])
WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    long = "\n".join(prose(rng, 40) for _ in range(300))
    some = [prose(rng, rng.randrange(1, 120)) for _ in range(25)]
    some += [a + "\n" + b for a, b in zip(some, some[3:9])]
    return [
        None, "", " \t\n\x0b\x0c\r ", "a", "A", "Ab cd", "aB CD", "İSTANBUL ÉÈ", "İstanbul éÈ", long, long, long.upper(), "x" * 70000, "one\ntwo\none\n\ntwo\n one ", "\ue000 odd \ue001 chars 😀😀",
        "again and again " * 60, "<|endoftext|> is a word here", *some, *some[:5],
    ]


def rows(seed=1):
    out = []
    for k, t in enumerate(texts(seed)):
        out.append((k * 7 % 61 * 1000003 + k, t, None if k % 9 == 0 else "en", [None, "", "b", "a", "É", "a"][k % 6], None if t is None else len(t), "x", k, "big"))
    out.append((None, "no id", "en", "a", 5, None, None, None))
    out.append((None, None, None, None, None, None, None, None))
    return out + out[3:6] + out[20:22]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).coalesce(3)


def docs_of(spark, pairs, source="s"):
    return table(spark, [(i, t, "en", source, None if t is None else len(t), None, None, None) for i, t in pairs])


def words(t):
    out, cur = [], ""
    for c in t or "":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out + ([cur] if cur else [])


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
