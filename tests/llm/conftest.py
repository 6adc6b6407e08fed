import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that operators use inside, or might.
CLASHING = ["h", "key", "n", "pos", "line", "pattern", "shard", "bin", "keep", "score", "root", "a", "b", "group_id", "hash", "size", "stem", "slot", "predicted", "n_tokens", "line_hash", "signature", "item_id", "count", "_cl_h", "_CL_N", "_cl_pos", "_cl_short", "_cl_winner", "_cl_id", "_cl_lang", "_cl_ok", "a.b", "c`d"]


@pytest.fixture
def make(spark):
    def make(rows, clashing=False):
        """rows: texts, (doc_id, text) or (doc_id, text, lang)."""
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            text = r[1]
            full.append((r[0], text, r[2] if len(r) > 2 else "en", "s", None if text is None else len(text)))
        df = spark.createDataFrame(full, SCHEMA)
        if clashing:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("clash") for c in CLASHING})
        return df

    return make


@pytest.fixture(scope="session")
def corpus():
    """A small invented corpus in two languages."""
    import random

    rng = random.Random(5)
    a = ["the", "of", "and", "river", "stone", "under", "walking", "letter", "morning", "window", "paper", "garden", "silver", "quiet", "number", "between"]
    b = ["der", "und", "nicht", "fluss", "stein", "unter", "brief", "morgen", "fenster", "garten", "silber", "leise", "zwischen", "schreiben", "gehen", "auf"]

    def text(words, n):
        out = []
        for i in range(n):
            w = rng.choice(words)
            out.append((w.capitalize() if i % 9 == 0 else w) + (".\n" if i % 27 == 26 else "." if i % 9 == 8 else ""))
        return " ".join(out).replace("\n ", "\n")

    return [(i, text(a if i % 3 else b, rng.randint(30, 200)), "en" if i % 3 else "de") for i in range(90)]
