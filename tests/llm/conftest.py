import random

import pytest

#: Columns whose names the operators use inside.
CLASHES = "digest bigint, content string, salt int, h bigint, bands string, sign string, stats string, row string, key bigint, ids string, length int, piece int, kept boolean, sha string, uid int, starts int, component int, decoded string, n int, p int"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["the", "of", "and", "to", "river", "stone", "carries", "evening", "light", "over", "fields", "where", "people", "walk", "in", "quiet", "lanes", "with", "old", "houses", "café", "naïve"]
    return " ".join(r.choice(words) + str(r.randrange(50) if r.random() < 0.3 else "") for _ in range(n))


def texts() -> list[str | None]:
    base, passage = prose(1, 120), prose(2, 70)
    words = base.split()
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in (3, 60, 117)]
    far = " ".join(w if i % 5 else "other" for i, w in enumerate(words))
    return [
        None, None, "", "", "   \n\t ", "one", "two words", base, base, base, *near, far, base.upper(), passage, prose(3, 80) + "\n" + passage, passage + " " + prose(4, 90),
        "a" * 5000, "ab" * 3000, "a" * 450 + "b", "é" * 300, prose(5, 20000), "word " * 400, "<|endoftext|> don't WE'LL İΣ x́ \U0001f600" * 3, "あい 12,5 ²",
        "### $$$ %%% &&& " * 30, "line one here\n" * 12, *[prose(100 + i, 40 + i) for i in range(12)],
    ]


def rows() -> list[tuple]:
    own = [(i if i != 6 else None, t, ["en", "fr", None][i % 3], "s", None, *[None] * 20) for i, t in enumerate(texts())]
    return [*own, own[7], own[15], (None, None, None, None, None, *[None] * 20)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def table_dir(tmp_path):
    """Writes frames as the driver's tables and gives their folder."""

    def put(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put
