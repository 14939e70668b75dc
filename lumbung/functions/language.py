"""Indonesian or English, by function words and affixes: a two-tier rule as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words of the two languages, content words and affixes of Indonesian.
ID_WORDS = (
    "yang dan untuk dengan pada dari ini itu tidak akan adalah dalam tersebut dapat oleh sebagai juga karena atau telah lebih sudah bahwa "
    "para serta agar hingga namun yaitu kami kita mereka sangat hanya masih bisa"
).split()
EN_WORDS = (
    "the and of to in is that for with as are was be by this an at from it which have has been were their these such than then there we "
    "our can will would should between during into"
).split()
ID_CONTENT = (
    "sebut harus perempuan hari tahun bulan kerja sama bersama solusi kurangi pemakaian menembus menjawab persoalan ilmu sekat semangat "
    "kesehatan kebersamaan gaungkan langkah solidaritas energi listrik minyak batubara terbarukan nasional pembangunan kebijakan penelitian "
    "kajian laporan acara kegiatan berita tentang melalui menjadi sebagai terhadap antara masyarakat pemerintah negara dunia baru besar "
    "tinggi rendah banyak sedikit buku peluncuran diskusi seminar pelatihan kunjungan penghargaan kerjasama pengembangan"
).split()
ID_AFFIXES = r"^(mem|men|meng|meny|pem|pen|peng|peny|ber|ter|di)[a-z]{4,}$|[a-z]{3,}(nya|kan)$"
LONG_TEXT, SHORT_TEXT = 200, 12


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.trim(text)), F.lit("[a-zÀ-ɏ]+"), 0)


def detect(text: Column) -> Column:
    """struct(language, confidence): 'id', 'en' or null.

    From 200 characters on, the shares of function words decide; a shorter text, from 12 on, is judged by content words
    and affixes too, with a confidence of at most 0.6. Equal signals, and no signal, give null and 0.
    """
    length = F.length(F.trim(text))

    def judged(tokens: Column) -> Column:
        hits = lambda words: F.size(F.filter(tokens, lambda w: w.isin(*words)))
        n = F.size(tokens)
        by_id, by_en = hits(ID_WORDS), hits(EN_WORDS)
        wide = hits(sorted({*ID_WORDS, *ID_CONTENT})) + F.size(F.filter(tokens, lambda w: w.rlike(ID_AFFIXES)))
        long = F.struct(F.when(by_id > by_en, F.lit("id")).otherwise(F.lit("en")).alias("language"), F.bround(F.abs(by_id - by_en) / F.nullif(by_id + by_en, F.lit(0)), 3).alias("confidence"))
        short = F.struct(F.when(wide > by_en, F.lit("id")).otherwise(F.lit("en")).alias("language"), F.bround(F.least(F.lit(0.6), F.abs(wide - by_en) / F.greatest(n, F.lit(1)) * 3), 3).alias("confidence"))
        none = F.struct(F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"))
        return F.when(text.isNull() | (length < SHORT_TEXT) | (n == 0), none).when((length >= LONG_TEXT) & (by_id + by_en > 0), long).when(wide != by_en, short).otherwise(none)

    # bound as a lambda's variable, the words are made once
    return F.transform(F.array(words_of(text)), judged)[0]


def resolve(declared: Column, text: Column, url: Column, title: Column) -> Column:
    """struct(language, confidence, source): as declared, else by the address, the text, the title; else English."""
    code = F.substring(F.lower(F.trim(declared)), 1, 3)
    of = lambda c, p, s: F.struct(c.alias("language"), p.cast("double").alias("confidence"), F.lit(s).alias("source"))
    body, head = detect(text), detect(title)
    return (
        F.when(code.isin("en", "eng"), of(F.lit("en"), F.lit(1.0), "declared"))
        .when(code.isin("id", "ind", "in"), of(F.lit("id"), F.lit(1.0), "declared"))
        .when(F.contains(url, F.lit("/id/")), of(F.lit("id"), F.lit(0.9), "declared"))
        .when(F.contains(url, F.lit("/en/")), of(F.lit("en"), F.lit(0.9), "declared"))
        .when(body["language"].isNotNull(), of(body["language"], body["confidence"], "detected"))
        .when(head["language"].isNotNull(), of(head["language"], head["confidence"], "detected"))
        .otherwise(of(F.lit("en"), F.lit(0.0), "detected"))
    )
