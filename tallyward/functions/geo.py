"""Country centroids and great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.fixed import COUNTRY_CENTROIDS, EARTH_RADIUS_KM


def centroids(spark: SparkSession) -> DataFrame:
    """The fixed 42-row table (countryIso, lat, lon)."""
    rows = ", ".join(f"('{iso}', {lat}D, {lon}D)" for iso, (lat, lon) in COUNTRY_CENTROIDS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(countryIso, lat, lon)")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_dlat = (phi2 - phi1) / 2
    half_dlon = (F.radians(lon2) - F.radians(lon1)) / 2
    chord = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(phi1) * F.cos(phi2) * F.sin(half_dlon) * F.sin(half_dlon)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))


def with_distance(pairs: DataFrame, from_iso: str, to_iso: str, alias: str = "distanceKm") -> DataFrame:
    """Add the distance between two country columns; NULL if either has no centroid."""
    table = centroids(pairs.sparkSession)

    def side(tag: str) -> DataFrame:
        return F.broadcast(table.select(
            F.col("countryIso").alias(f"iso_{tag}"),
            F.col("lat").alias(f"lat_{tag}"), F.col("lon").alias(f"lon_{tag}")))

    return (
        pairs
        .join(side("a"), F.col(from_iso) == F.col("iso_a"), "left")
        .join(side("b"), F.col(to_iso) == F.col("iso_b"), "left")
        .withColumn(alias, haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))
        .drop("iso_a", "lat_a", "lon_a", "iso_b", "lat_b", "lon_b")
    )
