import random

import pytest

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside; as extra columns of an input they must do no harm.
CLASHES = ["_n", "_k0", "_row", "_at", "_lo", "_hi", "_slot", "_block", "_start", "_offsets", "id", "node", "root", "u", "v", "f0", "t", "h", "shard", "island", "tokens", "text_hash", "maybe_repeated", "mix_slot", "mix_source", "mix_bucket", "toxic_score", "toxic_flag", "url_blocked", "url_rule", "license", "license_origin", "line", "path", "below", "dir", "own_id", "dup_root", "dup_id", "near", "unit", "dropped_id", "_file", "_metadata"]


@pytest.fixture
def table(spark):
    """A table of rows, with columns whose names clash with inner ones where clash is set."""

    def make(rows, schema, clash=False):
        df = spark.createDataFrame(rows, schema)
        if clash:
            from pyspark.sql import functions as F

            have = {c.lower() for c in df.columns}
            df = df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES) if c not in have], F.create_map(F.lit("a"), F.lit(1)).alias("a map"))
        return df

    return make


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def prose():
    """A maker of texts of invented words."""
    syllables = "ka lo mi ne ru sa ti vo xe zu pra ste".split()

    def make(rng, n, vocabulary=2000):
        def word(k):
            r = random.Random(k)
            return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

        return " ".join(word(rng.randrange(vocabulary)) for _ in range(n))

    return make
