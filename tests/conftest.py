import itertools
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("gridweave-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_points(spark):
    def build(coords, axes=None):
        coords = np.asarray(coords, dtype=float)
        axes = axes or ("x", "y", "z")[: coords.shape[1]]
        pdf = pd.DataFrame(coords, columns=list(axes))
        pdf.insert(0, "id", np.arange(len(pdf)))
        pdf["len"] = 0.1
        return spark.createDataFrame(pdf)

    return build


@pytest.fixture(scope="session")
def make_matrix(spark):
    def build(a):
        a = np.asarray(a, dtype=float)
        i, j = np.indices(a.shape)
        return spark.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": a.ravel()}))

    return build


def lattice(*shape):
    return np.array(list(itertools.product(*[range(n) for n in shape])), dtype=float)


def dense_kernel(pts, eps=1e-3):
    """The kernel matrix of a point set, patch-major, by the definition."""
    pts = np.asarray(pts, dtype=float)
    n, d = pts.shape
    r = pts[:, None, :] - pts[None, :, :]
    den = np.linalg.norm(r, axis=2) + eps
    k = (np.eye(d) + r[..., :, None] * r[..., None, :] / den[..., None, None] ** 2) / den[..., None, None] ** d
    return k[..., : d - 1].transpose(0, 2, 1, 3).reshape(n * d, n * (d - 1))


def to_dense(df, shape):
    out = np.zeros(shape)
    pdf = df.toPandas()
    np.add.at(out, (pdf["i"], pdf["j"]), pdf["v"])
    return out


def to_vector(df, key, n, value="y"):
    out = np.zeros(n)
    pdf = df.toPandas()
    assert pdf[key].is_unique
    out[pdf[key]] = pdf[value]
    return out
