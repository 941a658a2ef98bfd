"""Tables with every oddity the operators must take, and plain re-implementations to compare with."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, score double, kept boolean, fingerprint string, bucket long, key long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts():
    rng = random.Random(7)
    vocabulary = [a + b for a in ("ab", "Ünd", "the", "x", "日本") for b in ("", "er", "ing", "on.", "é", "##")]
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = draw(120), draw(40)
    near = base.split()
    near[60] = "changed"
    out = [
        base, base, " ".join(near), base.upper(), None, "", "  \n\t ", "one", "one two three", "one two three", draw(30) + "\n" + passage + "\n" + draw(30), passage + " " + draw(50),
        draw(9000), "same line here\n" * 40, "a" * 5000, draw(70), draw(70), "\n".join([draw(12)] * 3 + [draw(12)]), " lead and trail ", "nul\x00 and � marks", passage,
    ]
    return [(i, t) for i, t in enumerate(out)]


def odd_docs(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [(i * 3 + 1, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 2}", None if t is None else len(t), 5, "r", 0.5, True, "f", 1, 2) for i, t in odd_texts()]
    rows += [rows[10], rows[5], (None, "no id at all " * 9, "en", "s0", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def ids_and_texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]
