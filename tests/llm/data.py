"""Documents with every odd case, and helpers."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(n, seed=0):
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] + str((seed + i) % 13) for i in range(n))


ODD = [
    (1, text(60, 1)), (2, text(60, 1)), (3, text(60, 1)[:-3] + "zzz"), (4, text(60, 2)), (5, ""), (6, None), (7, "   \n\t "), (8, "one"), (9, "one two"),
    (10, text(20000, 3)), (11, "é" * 50 + " 字 😀"), (1, text(60, 1)), (12, "a@b.co and 10.0.0.1"), (None, text(30, 9)),
]


def frame(spark, rows=ODD, more="lang string, source string, n_chars long"):
    filled = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, {more}")


def tables(spark, at, **frames):
    """Writes tables as the driver has them; returns the folder."""
    for name, df in frames.items():
        df.write.parquet(f"{at}/{name}.parquet")
    return str(at)
