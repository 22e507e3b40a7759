"""Shared by the tests of this folder."""

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None or v != v else v.item() if hasattr(v, "item") else v


def rows_equal(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    both = [sorted((tuple(map(plain, r)) for r in x[cols].itertuples(index=False, name=None)), key=repr) for x in (a, b)]
    return both[0] == both[1]
