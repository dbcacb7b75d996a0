"""Reference profiles and series of test flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The lid-driven cavity at Reynolds number 1000, from the tables of Ghia, Ghia and Shin (1982): velocity u along
# the vertical centre line (coordinate y), and v along the horizontal one (coordinate x).
CAVITY = {
    "u": [
        (0.0, 0.0), (0.0547, -0.03717), (0.0625, -0.04192), (0.0703, -0.04775), (0.1016, -0.06434), (0.1719, -0.1015), (0.2813, -0.15662), (0.4531, -0.2109), (0.5, -0.20581),
        (0.6172, -0.13641), (0.7344, 0.00332), (0.8516, 0.23151), (0.9531, 0.68717), (0.9609, 0.73722), (0.9688, 0.78871), (0.9766, 0.84123), (1.0, 1.0),
    ],
    "v": [
        (0.0, 0.0), (0.0625, 0.09233), (0.0703, 0.10091), (0.0781, 0.1089), (0.0938, 0.12317), (0.1563, 0.16077), (0.2266, 0.17507), (0.2344, 0.17527), (0.5, 0.05454),
        (0.8047, -0.24533), (0.8594, -0.22445), (0.9063, -0.16914), (0.9453, -0.10313), (0.9531, -0.08864), (0.9609, -0.07391), (0.9688, -0.05906), (1.0, 0.0),
    ],
}


def cavity(spark: SparkSession) -> DataFrame:
    """(component, coord, value)."""
    return spark.createDataFrame([(c, *p) for c, points in CAVITY.items() for p in points], "component string, coord double, value double")


def decayed(t: Column, reynolds: float, energy: float = 1.0) -> Column:
    """The kinetic energy of the decaying vortex at time t."""
    return energy * F.exp(-4 * t / reynolds)


def energy_series(spark: SparkSession, reynolds: float, last: float, n: int) -> DataFrame:
    """(i, t, energy) at n times from 0 to ``last``."""
    t = F.col("i") * (last / max(1, n - 1))
    return spark.range(n).select(F.col("id").alias("i")).select("i", t.alias("t"), decayed(t, reynolds).alias("energy"))
