VOCABULARY = [a + b for a in "bcdfghklmnprst" for b in ("a", "en", "ira", "olt", "um")]


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))
