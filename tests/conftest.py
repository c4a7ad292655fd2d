import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lanespan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


RUNS = "group string, frame_idx bigint, y int, x0 int, x1 int"
DIMS = "group string, frame_idx bigint, height int, width int"


def spans_of(mask: np.ndarray, frame: int, group: str = "g"):
    """Brute-force spans of a boolean matrix."""
    rows = []
    for y, line in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], line.astype(int), [0]))))
        rows += [(group, frame, y, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
    return rows


@pytest.fixture(scope="session")
def mask_table(spark):
    def build(masks):
        """Span and size tables of a list of boolean matrices, frame by frame."""
        rows = [r for i, m in enumerate(masks) for r in spans_of(m, i)]
        dims = [("g", i, *m.shape) for i, m in enumerate(masks)]
        return spark.createDataFrame(rows, RUNS), spark.createDataFrame(dims, DIMS)

    return build


@pytest.fixture(scope="session")
def to_masks():
    def build(runs, shapes):
        masks = [np.zeros(s, bool) for s in shapes]
        for r in runs.collect():
            assert not masks[r.frame_idx][r.y, r.x0 : r.x1].any(), "spans overlap"
            masks[r.frame_idx][r.y, r.x0 : r.x1] = True
        return masks

    return build
