"""Default stopword lists. Any other list is passed as a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sentigrid.config import MAX_WORD_LIST

# --- fixed values: function words -------------------------------------------------------
INDONESIAN = (
    "ada adalah agar akan aku anda antara apa apakah atas atau bagi bahwa banyak beberapa "
    "begitu belum berbagai bisa bukan dalam dan dapat dari daripada demi dengan di dia dua "
    "hanya harus hingga ia ini itu jadi jika juga kali kalau kami kamu karena kata ke kemudian "
    "kepada ketika kita lagi lain lalu lebih maka masih mereka namun nya oleh pada para pun saat "
    "saja sambil sampai sangat satu saya sebagai sebelum sebuah sedang sehingga sejak sekali "
    "seluruh semua seorang seperti serta sesuatu setelah setiap sudah supaya tanpa tapi telah "
    "tentang terhadap tersebut tetapi tidak untuk yaitu yakni yang"
).split()
ENGLISH = (
    "a about above after again against all am an and any are as at be because been before "
    "being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it "
    "its itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your yours yourself yourselves"
).split()
# --- end of fixed values ----------------------------------------------------------------

DEFAULT = INDONESIAN


def from_table(table: DataFrame) -> list[str]:
    """Stopwords from a (term) table; one larger than the bound is refused."""
    rows = table.select("term").distinct().limit(MAX_WORD_LIST + 1).collect()
    if len(rows) > MAX_WORD_LIST:
        raise ValueError(f"a stopword list holds at most {MAX_WORD_LIST} terms")
    return [r.term for r in rows]
