"""Small fixtures of the operator tests."""
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that an input may have besides its own, named like columns the operators use inside.
CLASH = "score double, row long, held boolean, size long, n long, fp long, site string, x int, key string, digest string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def rows(pairs):
    """(doc_id, text) or (doc_id, text, lang, source) to rows of SCHEMA."""
    out = []
    for p in pairs:
        i, text, lang, source = (*p, *("en", "s1")[len(p) - 2:])[:4] if len(p) < 4 else p
        out.append((i, text, lang, source, len(text or ""), 0.5, 7, True, 3, 1, 2, "a", 1, "k", "d"))
    return out


def docs(spark, pairs):
    return spark.createDataFrame(rows(pairs), SCHEMA)


def words(text):
    return WORD.findall(text or "")


def odd_texts():
    """Nulls in every column, empty, blank and long texts, ties and repeated rows."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [text(rng.randint(5, 80)) for _ in range(40)]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None])) for i, t in enumerate(base)]
    out += [(100, None, None, None), (101, "", "en", "s1"), (102, " \n\t ", "en", "s1"), (103, "\n".join(text(30) for _ in range(400)), "en", "s2"),
            (104, base[0], "en", "s1"), (104, base[0], "en", "s1"), (105, base[0].upper(), "en", "s2"), (None, base[1], "en", "s1"),
            (106, "word", "fr", "s2"), (107, "Ünïcode 😀 words\x0bhere\x1c", "fr", "s2")]
    return out
