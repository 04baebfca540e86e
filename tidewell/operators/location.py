"""Places: a gazetteer and the lookup of location strings in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T

SEPARATORS = ("-", "/", ",", "|")

# A small gazetteer for use where no other is given (name, latitude, longitude, population).
FALLBACK = [
    ("Berlin", 52.5200, 13.4050, 3426354), ("Hamburg", 53.5507, 9.9930, 1845229), ("Munich", 48.1374, 11.5755, 1260391), ("Cologne", 50.9333, 6.9500, 963395),
    ("Frankfurt am Main", 50.1155, 8.6841, 650000), ("Stuttgart", 48.7758, 9.1829, 628000), ("Düsseldorf", 51.2217, 6.7762, 612000), ("Leipzig", 51.3397, 12.3731, 570000),
    ("Dortmund", 51.5153, 7.4656, 580000), ("Essen", 51.4556, 7.0116, 580000), ("Bremen", 53.0793, 8.8017, 557000), ("Dresden", 51.0509, 13.7383, 550000),
    ("Hannover", 52.3744, 9.7386, 530000), ("Nuremberg", 49.4478, 11.0683, 515000), ("Duisburg", 51.4349, 6.7623, 496000), ("Bochum", 51.4818, 7.2162, 365000),
    ("Wuppertal", 51.2562, 7.1508, 357000), ("Bielefeld", 52.0302, 8.5325, 333000), ("Bonn", 50.7341, 7.0941, 329000), ("Münster", 51.9607, 7.6261, 316000),
    ("Karlsruhe", 49.0069, 8.4037, 308000), ("Mannheim", 49.4878, 8.4660, 309000), ("Augsburg", 48.3717, 10.8983, 295000), ("Wiesbaden", 50.0782, 8.2398, 277000),
    ("Gelsenkirchen", 51.5177, 7.0857, 265000), ("Mönchengladbach", 51.1805, 6.4428, 261000), ("Braunschweig", 52.2689, 10.5268, 249000), ("Chemnitz", 50.8278, 12.9214, 247000),
    ("Kiel", 54.3233, 10.1394, 247000), ("Aachen", 50.7762, 6.0838, 245000), ("Halle", 51.4825, 11.9675, 238000), ("Magdeburg", 52.1317, 11.6392, 237000),
    ("Freiburg im Breisgau", 47.9990, 7.8421, 229000), ("Krefeld", 51.3388, 6.5853, 227000), ("Lübeck", 53.8655, 10.6866, 216000), ("Oberhausen", 51.4699, 6.8522, 211000),
    ("Erfurt", 50.9777, 11.0290, 212000), ("Mainz", 49.9929, 8.2473, 213000), ("Rostock", 54.0887, 12.1400, 209000), ("Kassel", 51.3127, 9.4797, 202000),
    ("Hagen", 51.3671, 7.4633, 189000), ("Potsdam", 52.3906, 13.0645, 180000), ("Saarbrücken", 49.2402, 6.9969, 180000), ("Hamm", 51.6739, 7.8152, 179000),
    ("Ludwigshafen am Rhein", 49.4814, 8.4352, 172000), ("Mülheim an der Ruhr", 51.4296, 6.8825, 170000), ("Oldenburg", 53.1434, 8.2146, 168000), ("Osnabrück", 52.2799, 8.0472, 165000),
    ("Leverkusen", 51.0459, 6.9946, 163000), ("Heidelberg", 49.4094, 8.6942, 158000),
]


def top_places(lines: DataFrame, most: int = 2000) -> DataFrame:
    """The most populous places of tab-separated gazetteer lines (value): class P, 15 fields or more, readable numbers."""
    f = F.split("value", "\t")
    rows = lines.filter(F.size(f) >= 15).filter(F.get(f, F.lit(6)) == "P")
    rows = rows.select(F.get(f, F.lit(1)).alias("name"), F.get(f, F.lit(4)).try_cast("double").alias("lat"), F.get(f, F.lit(5)).try_cast("double").alias("lon"), F.get(f, F.lit(14)).try_cast("long").alias("population"), F.get(f, F.lit(3)).alias("alternate_names"))
    return rows.filter("lat IS NOT NULL AND lon IS NOT NULL AND population IS NOT NULL").orderBy(F.desc("population"), "name").limit(most)


def fallback(spark: SparkSession) -> DataFrame:
    """The small gazetteer in the form of place_index()'s input."""
    return spark.createDataFrame([(*p, "", i) for i, p in enumerate(FALLBACK)], "name string, lat double, lon double, population long, alternate_names string, pos int")


def place_index(gazetteer: DataFrame) -> DataFrame:
    """key, name, lat, lon: a place's own name wins over other names, later rows over earlier ones (earlier among other names).

    Codes of up to three capitals and names with a hyphen or space are no other names.  ``gazetteer``
    is in the order of its ``pos`` column.
    """
    own = gazetteer.select(T.unaccented(T.strip(F.col("name"))).alias("key"), F.lit(0).alias("kind"), (-F.col("pos")).alias("order"), "name", "lat", "lon")
    other = gazetteer.select(F.posexplode(F.split(T.blank(F.col("alternate_names")), ",")).alias("at", "alt"), "pos", "name", "lat", "lon").withColumn("alt", T.strip(F.col("alt")))
    code = (F.length("alt") <= 3) & (F.upper("alt") == F.col("alt")) & F.col("alt").rlike(r"\p{L}")
    other = other.filter((F.col("alt") != "") & ~code & ~F.col("alt").rlike("[- ]"))
    other = other.select(T.unaccented(F.col("alt")).alias("key"), F.lit(1).alias("kind"), (F.col("pos") * 10000 + F.col("at")).alias("order"), "name", "lat", "lon")
    w = Window.partitionBy("key").orderBy("kind", "order")
    return own.unionByName(other).withColumn("_no", F.row_number().over(w)).filter("_no = 1").select("key", F.trim("name").alias("name"), "lat", "lon")


def candidates(location: Column) -> Column:
    """The whole cleaned string, then its parts by each separator in turn."""
    whole = T.without_brackets(location)
    parts = [F.when(F.contains(whole, F.lit(s)), F.transform(F.split(whole, f"\\{s}"), T.strip)).otherwise(F.array().cast("array<string>")) for s in SEPARATORS]
    return F.concat(F.array(whole), *parts)


def located(jobs: DataFrame, index: DataFrame) -> DataFrame:
    """``jobs`` with location_normalized, location_lat, location_lon (of the first candidate that the index has), is_remote and is_hybrid."""
    probe = jobs.filter(T.blank(F.col("location")) != "").select("id", F.posexplode(candidates(F.col("location"))).alias("at", "name_part"))
    found = probe.withColumn("key", T.unaccented(F.col("name_part"))).join(index, "key").groupBy("id").agg(F.min_by(F.struct("name", "lat", "lon"), "at").alias("place"))
    rows = jobs.join(found, "id", "left")
    return rows.select(
        *jobs.columns, F.col("place.name").alias("location_normalized"), F.col("place.lat").alias("location_lat"), F.col("place.lon").alias("location_lon"),
        T.is_remote(F.col("location")).alias("is_remote"), T.is_hybrid(F.col("location")).alias("is_hybrid"),
    )
