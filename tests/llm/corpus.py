"""Small tables for the corpus operators: random prose with copies, and rows with everything odd."""

import random
import re

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
TURN = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {
    "en": ["the", "ing", "er", "on", "wh", "st", "ea", "nd", "th", "ou"],
    "de": ["sch", "ein", "keit", "ung", "ü", "der", "ver", "tz", "pf", "ä"],
    "es": ["ción", "os", "ñ", "ar", "el", "do", "ez", "ie", "lla", "que"],
}


def prose(rng, lang="en", words=60):
    made = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words)]
    out = []
    for k, word in enumerate(made):
        end = rng.random()
        out.append(word + ("." if end < 0.08 else ".\n" if end < 0.12 else " " if k else " "))
    return " ".join(out).replace(".\n ", ".\n").strip()


def altered(rng, text, times):
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


def documents(seed=5, count=90):
    """(doc_id, text, lang, source, n_chars) with exact and near copies, and toxic ones marked."""
    rng = random.Random(seed)
    rows, toxic = [], set()
    for k in range(count):
        lang = rng.choice(["en", "en", "de", "es"])
        text = prose(rng, lang, rng.randint(20, 140))
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.4:
            text = altered(rng, rng.choice(rows)[1], rng.randint(1, 5))
        elif kind < 0.6:
            words = text.split(" ")
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "loser"]))
            text = " ".join(words)
        if re.search("idiot|moron|loser", text):
            toxic.add(k * 3)
        rows.append((k * 3, text, lang, f"src{rng.randrange(4)}", len(text)))
    return rows, toxic


def odd_documents():
    """NULL in every column, empty and very long texts, repeated rows and marks operators use."""
    long = " ".join(f"word{k % 977} and" for k in range(60_000))
    spaceless = "x" * 300_000 + "@" + "1" * 50_000
    return [
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, " \t\n ", None, "a", 3),
        (4, long, "en", "b", len(long)),
        (5, spaceless, "de", "b", len(spaceless)),
        (6, "ﷰ ﷐﷑     😀 a@b.co", "es", "b", None),
        (7, "same text here for all of them to see", "en", "a", 5),
        (7, "same text here for all of them to see", "en", "a", 5),
        (8, "same text here for all of them to see", "en", "A", 5),
        (None, "same text here for all of them to see", "en", "a", 5),
        (None, None, None, None, None),
        (9, "one", "en", "a", 3),
    ]


def write_tables(spark, root, rows, toxic=(), benchmark=(), vectors=(), turns=(), extra=True):
    """The tables the queries read; documents get columns named like results."""
    docs = spark.createDataFrame(rows, DOCUMENT)
    if extra:
        for name in ("score", "size", "SLOT", "shard", "taken", "hits", "spans", "tokens", "drawn",
                     "repeats", "IDS", "decoded"):
            docs = docs.selectExpr("*", f"'kept' AS {name}")
    docs.write.parquet(f"{root}/documents.parquet")
    marks = [(r[0], 1, int(r[0] in toxic)) for r in rows] + [(10**6, None, None), (None, 0, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(
        f"{root}/labels.parquet"
    )
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(
        f"{root}/benchmark.parquet"
    )
    spark.createDataFrame(
        list(vectors), "vec_id long, embedding array<float>, label int"
    ).write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame(list(turns), TURN).selectExpr("*", "'kept' AS edit").write.parquet(
        f"{root}/conversations.parquet"
    )
    return str(root)


class Groups:
    """Groups of linked things, named by their smallest member."""

    def __init__(self, members):
        self.parent = {m: m for m in members}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
