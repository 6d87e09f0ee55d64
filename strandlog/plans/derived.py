"""The driver's tables seen as a ledger, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.hashing import author_id_column, section_hash_column, struct_hash

LICENSES = {"en": "MIT", "fr": "CC-BY-SA-4.0", "de": "Apache-2.0"}


class Views:
    """Lazy views over one folder of tables; every text column is read only where a view needs it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def _author(source: Column) -> Column:
        return author_id_column(source, F.concat(source, F.lit("@example.com")))

    def _section(self, source: Column, lang: Column) -> Column:
        return section_hash_column(self._path(source, lang), self._writers(source, lang), self._license(lang), F.lit("2024"))

    @staticmethod
    def _path(source: Column, lang: Column) -> Column:
        return F.concat(F.lit("raw/"), source, F.lit("/"), lang, F.lit(".txt"))

    def _writers(self, source: Column, lang: Column) -> Column:
        own = self._author(source)
        return F.when(lang == "fr", F.array(own, self._author(F.lit("src0")))).otherwise(F.array(own))

    @staticmethod
    def _license(lang: Column) -> Column:
        out = F.lit("")
        for k, v in LICENSES.items():
            out = F.when(lang == k, v).otherwise(out)
        return out

    def authors(self) -> DataFrame:
        s = F.col("source")
        names = self.table("documents").select("source").distinct()
        return names.select(self._author(s).alias("id"), s.alias("name"), F.concat(s, F.lit("@example.com")).alias("email"), s.isin("src3", "src7").alias("revoked"))

    def sections(self) -> DataFrame:
        s, lang = F.col("source"), F.col("lang")
        pairs = self.table("documents").select("source", "lang").distinct()
        return pairs.select(
            self._section(s, lang).alias("section_hash"),
            self._path(s, lang).alias("path"),
            self._writers(s, lang).alias("authors"),
            F.array().cast("array<string>").alias("contributors"),
            self._license(lang).alias("license"),
            F.lit("2024").alias("year"),
            ((s == "src5") & (lang == "de")).alias("revoked"),
        )

    def records(self, text: bool = False) -> DataFrame:
        """Every fifth document also has the English section of src2 as a source; every 97th is revoked itself."""
        s, lang = F.col("source"), F.col("lang")
        own = self._section(s, lang)
        both = F.when(F.col("doc_id") % 5 == 0, F.array(own, self._section(F.lit("src2"), F.lit("en")))).otherwise(F.array(own))
        return self.table("documents").select(
            F.col("doc_id").alias("row_id"),
            struct_hash(text=F.col("text")).alias("line_hash"),
            F.concat(F.lit("data/"), s, F.lit(".jsonl")).alias("file"),
            both.alias("sources"),
            F.lit("track").alias("source_type"),
            (F.col("doc_id") % 97 == 0).alias("revoked"),
            F.lit(False).alias("orphan"),
            *(["text"] if text else []),
        )

    def tokens(self) -> DataFrame:
        s, lang = F.col("source"), F.col("lang")
        return self.table("documents").select(
            F.col("doc_id").alias("pos"),
            F.size(F.split("text", " ")).cast("long").alias("token_count"),
            F.array(self._section(s, lang)).alias("sources"),
            F.lit("ws").alias("tokenizer"),
            (F.col("doc_id") % 7 == 0).alias("revoked"),
        )

    def log(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("op"), "props")

    def embeddings(self) -> DataFrame:
        """Each vector under the number of its id divided by 3: the last of each three counts."""
        return self.table("embeddings").select((F.floor(F.col("vec_id") / 3)).cast("string").alias("line_hash"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit("m").alias("model"), F.col("vec_id").alias("seq"), "vec_id")


PRELUDE = """
WITH authors AS (
  SELECT DISTINCT sha256('{"email":"' || source || '@example.com","name":"' || source || '"}') AS id, source AS name,
    source || '@example.com' AS email, source IN ('src3', 'src7') AS revoked
  FROM documents
), pairs AS (
  SELECT DISTINCT source, lang, 'raw/' || source || '/' || lang || '.txt' AS path,
    CASE lang WHEN 'en' THEN 'MIT' WHEN 'fr' THEN 'CC-BY-SA-4.0' WHEN 'de' THEN 'Apache-2.0' ELSE '' END AS license,
    sha256('{"email":"' || source || '@example.com","name":"' || source || '"}') AS own,
    sha256('{"email":"src0@example.com","name":"src0"}') AS second
  FROM documents
), sections AS (
  SELECT source, lang, path, license, '2024' AS year, (source = 'src5' AND lang = 'de') AS revoked,
    CASE WHEN lang = 'fr' THEN [own, second] ELSE [own] END AS authors,
    sha256('{"authors":["' || own || '"' || CASE WHEN lang = 'fr' THEN ',"' || second || '"' ELSE '' END ||
      '],"contributors":[],"license":"' || license || '","path":"' || path || '","year":"2024"}') AS section_hash
  FROM pairs
), extra AS (
  SELECT sha256('{"authors":["' || a || '"],"contributors":[],"license":"MIT","path":"raw/src2/en.txt","year":"2024"}') AS h
  FROM (SELECT sha256('{"email":"src2@example.com","name":"src2"}') AS a)
), records AS (
  SELECT d.doc_id AS row_id, sha256(CAST(to_json({'text': d.text}) AS VARCHAR)) AS line_hash, 'data/' || d.source || '.jsonl' AS file,
    CASE WHEN d.doc_id % 5 = 0 THEN [s.section_hash, (SELECT h FROM extra)] ELSE [s.section_hash] END AS sources,
    d.doc_id % 97 = 0 AS revoked, d.source, d.lang
  FROM documents d JOIN sections s ON d.source = s.source AND d.lang = s.lang
), edges AS (
  SELECT row_id, unnest(sources) AS section_hash FROM records
), bad_sections AS (
  SELECT section_hash FROM sections WHERE revoked
  UNION SELECT section_hash FROM (SELECT section_hash, unnest(authors) AS a FROM sections) x JOIN authors ON a = id WHERE authors.revoked
), touched AS (
  SELECT DISTINCT row_id FROM edges JOIN bad_sections USING (section_hash)
), tokens AS (
  SELECT d.doc_id AS pos, CAST(len(string_split(d.text, ' ')) AS BIGINT) AS token_count, s.section_hash AS source_hash, d.doc_id % 7 = 0 AS revoked
  FROM documents d JOIN sections s ON d.source = s.source AND d.lang = s.lang
)
"""
