"""Field encryption: AES-GCM with the document and the field as associated data, so a value can't be moved to another place."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyLengthError(ValueError):
    """A key of a wrong length."""


def checked_key(key: bytes) -> bytes:
    if len(key) not in (16, 24, 32):
        raise KeyLengthError("a key has 16, 24 or 32 bytes")
    return key


def place(field: str, id_col: str) -> Column:
    return F.concat(F.lit("field:"), F.col(id_col).cast("string"), F.lit(f":{field}")).cast("binary")


def encrypted(df: DataFrame, fields: list[str], key: bytes, id_col: str = "_id") -> DataFrame:
    """df with these fields as bytes: each value as JSON, encrypted under a new nonce. Missing values stay missing."""
    k = F.lit(checked_key(key))
    for f in fields:
        text = F.to_json(F.struct(F.col(f"`{f}`").alias("v")))
        df = df.withColumn(f, F.when(F.col(f"`{f}`").isNotNull(), F.aes_encrypt(text.cast("binary"), k, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), place(f, id_col))))
    return df


def _text(f: str, key: bytes, id_col: str, tried: bool) -> Column:
    decrypt = F.try_aes_decrypt if tried else F.aes_decrypt
    return decrypt(F.col(f"`{f}`"), F.lit(checked_key(key)), F.lit("GCM"), F.lit("DEFAULT"), place(f, id_col)).cast("string")


def decrypted(df: DataFrame, kinds: dict[str, T.DataType | str], key: bytes, id_col: str = "_id") -> DataFrame:
    """The fields again, of the types given; a value of another key, document or field is an error."""
    for f, kind in kinds.items():
        name = kind if isinstance(kind, str) else kind.simpleString()
        df = df.withColumn(f, F.from_json(_text(f, key, id_col, False), f"v {name}").getField("v"))
    return df


def rekeyed(df: DataFrame, fields: list[str], old: bytes, new: bytes, id_col: str = "_id") -> DataFrame:
    """Values of the old key encrypted anew; those already under the new key stay, so a run that broke off can be repeated."""
    for f in fields:
        have, text = F.col(f"`{f}`"), _text(f, old, id_col, True)  # tried, as Spark may compute it for rows that don't need it
        fresh = F.aes_encrypt(text.cast("binary"), F.lit(checked_key(new)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), place(f, id_col))
        wrong = F.raise_error(F.lit(f"{f}: a value that neither key decrypts")).cast("binary")
        df = df.withColumn(f, F.when(have.isNull() | _text(f, new, id_col, True).isNotNull(), have).when(text.isNotNull(), fresh).otherwise(wrong))
    return df
