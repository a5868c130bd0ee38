"""Findings of round 4: signs of zeros, and work that grew faster than the input."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from latticework.operators import gestalt as G
from latticework.plans import catalogue
from oracle import compare


def test_candidate_lines_of_negative_zeros(spark, tmp_path):
    """A balance of negative zero, as rounding to cents makes it, keeps its sign; nan and inf read as in SQL (F2)."""
    con = duckdb.connect()
    con.execute("CREATE TABLE c AS SELECT i::BIGINT c_custkey, 'n' || i c_name, (i % 2)::INTEGER c_nationkey, round(['-0.003', '0.003', '-0.49', '-0.0', '0.0', 'nan', 'inf', '-inf', '-2.5', '0.499', NULL][i + 1]::DOUBLE, 2) c_acctbal, 'm' c_mktsegment FROM range(11) r(i)")
    con.execute(f"COPY c TO '{tmp_path}/customer.parquet'; COPY (SELECT i::INTEGER n_nationkey, 'N' || i n_name FROM range(2) r(i)) TO '{tmp_path}/nation.parquet'")
    con.execute(f"CREATE VIEW customer AS FROM '{tmp_path}/customer.parquet'; CREATE VIEW nation AS FROM '{tmp_path}/nation.parquet'")
    problem, n = compare(catalogue.queries()["candidate_lines"](spark, str(tmp_path)), con, catalogue.oracle_sql()["candidate_lines"])
    assert problem is None and n == 11
    assert con.execute(f"SELECT count(*) FROM ({catalogue.oracle_sql()['candidate_lines']}) WHERE shown LIKE '%|-0.000'").fetchall() == [(3,)]


def _invented(i):
    h = hashlib.md5(str(i).encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "aeioubcdfglmnprs"))
    return f"{h[:7]} {h[7:13]}"


def test_letters_are_compared_for_groups_of_texts():
    """The pairs that letter counts allow are those of a comparison of all pairs, whatever is open at a time (F4)."""
    for seed in range(60):
        rng = random.Random(seed)
        letters, longest = rng.choice(["ab", "abc ", "abcdefgh é", "0a1 "]), rng.choice([2, 6, 14])
        texts = lambda n: ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(n)]  # noqa: B023, E731
        (n, a), (m, c) = G._letters(pa.array(texts(rng.randrange(1, 30)))), G._letters(pa.array(texts(rng.randrange(1, 60))))
        own, other = np.array([rng.randrange(-1, 3) for _ in n]), np.array([rng.randrange(-1, 3) for _ in m])
        far = np.array([rng.choice([-0.1, 0.0, 0.3, 0.5, 0.8, 1.0]) for _ in n])
        near = far - 0.12
        least = np.where((own[:, None] == other) & (own[:, None] >= 0), near[:, None], far[:, None])
        common = np.minimum(a[:, :, None], c[:, None, :]).sum(0)
        want = np.argwhere(2.0 * common >= least * (n[:, None] + m) - 1e-6).tolist()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(G, "FRONTIER", rng.choice([1, 7, 100, 1 << 18]))
            got = [[int(i), int(j)] for row, col in G.letter_pairs(n, a, own, far, near, m, c, other) for i, j in zip(row, col, strict=True)]
        assert sorted(got) == want


def test_work_on_letters_follows_the_texts_that_are_close(monkeypatch):
    """Invented names four times as many on both sides: pairs grow 16 times, groups looked at 9 times at most (F4)."""
    looked, spans = [], G._spans
    monkeypatch.setattr(G, "_spans", lambda start, n: looked.append(int(n.sum())) or spans(start, n))
    work = []
    for size in (1024, 4096):
        known, asked = [x for i in range(size) for x in (_invented(i), f"customer {i:09d}")], [f"{_invented(i).split()[0]} institute" for i in range(size)]
        (n, a), (m, c) = G._letters(pa.array(asked)), G._letters(pa.array(known))
        looked.clear()
        list(G.letter_pairs(n, a, np.arange(size) % 5, np.full(size, 0.92), np.full(size, 0.8), m, c, np.arange(2 * size) // 2 % 5))
        work.append(sum(looked))
    assert work[1] <= 9 * work[0] and work[1] * 50 < 4096 * 8192
