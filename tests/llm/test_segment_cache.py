"""A full cache keeps the segments in use."""

from tessera.llm import tokens


def test_segments_in_use_outlive_a_full_cache():
    made = []
    cache = tokens._Segments(lambda piece: made.append(piece) or piece.encode())
    for k in range(50):
        assert cache["common"] == b"common" and cache[f"rare {k}"] == f"rare {k}".encode()
        if len(cache) > 8:
            cache.age()
    assert made.count("common") == 1 and len(made) == 51
    assert len(cache) + len(cache.last) <= 18
