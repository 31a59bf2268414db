"""Column expressions for display: local times, public URLs, encrypted media paths.

All are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The zone times are shown in, and the header of a salted ciphertext.
DISPLAY_ZONE = "Asia/Ho_Chi_Minh"
SALT_HEADER = b"Salted__"


def local_time_text(ts: Column, zone: str = DISPLAY_ZONE) -> Column:
    """A zone-less UTC timestamp (or date: midnight) as local ``MM/dd/yyyy HH:mm:ss``.

    Goes through the text form, not ``date_format``, which would shift the value once more by
    the zone of the session.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz")).cast("string")
    return F.concat(local.substr(6, 2), F.lit("/"), local.substr(9, 2), F.lit("/"), local.substr(1, 4), F.lit(" "), local.substr(12, 8))


def media_url(path: Column, marker: str, bucket: str, endpoint: str) -> Column:
    """Public URL of a stored object if the path has the marker, else the path as it is."""
    return F.when(path.contains(marker), F.concat(F.lit(f"https://{bucket}.{endpoint}/"), path)).otherwise(path)


def after_marker(path: Column, marker: str) -> Column:
    """Text between the first ``marker/`` and the next one; the whole text if there is none."""
    pieces = F.split(path, f"\\Q{marker}/\\E", -1)
    return F.coalesce(F.get(pieces, F.lit(1)), path)


def json_literal(text: Column) -> Column:
    """A JSON string literal in pure ASCII, non-ASCII characters as UTF-16 escapes."""
    quoted = F.regexp_replace(text, r'(["\\])', r"\\$1")
    # The short escapes of JSON.
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def escaped(ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        by_code = F.concat(
            F.lit("\\u"), units.substr(1, 4), F.when(F.length(units) > 4, F.concat(F.lit("\\u"), units.substr(5, 4))).otherwise("")
        )
        case = F.when(ch.rlike(r"\A[ -~]\z"), ch)
        for raw, code in short.items():
            case = case.when(ch == raw, code)
        return case.otherwise(by_code)

    # not ^ and $: the latter also matches before a last line end
    body = F.when(quoted.rlike(r"\A[ -~]*\z"), quoted).otherwise(F.array_join(F.transform(F.split(quoted, ""), escaped), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def key_and_iv(password: Column, salt: Column) -> tuple[Column, Column]:
    """AES-256 key and IV from a password and salt (both binary) by three chained MD5 digests."""
    secret = F.concat(password, salt)
    first = F.unhex(F.md5(secret))
    second = F.unhex(F.md5(F.concat(first, secret)))
    third = F.unhex(F.md5(F.concat(second, secret)))
    return F.concat(first, second), third


def row_salt(row_id: Column, nonce: str) -> Column:
    """Eight bytes that depend on the row and a secret nonce.

    A random salt would change whenever a lost task is run again; change the nonce per run.
    """
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", F.lit(nonce), row_id.cast("string")), 256), 1, 16))


def salted_aes(text: Column, password: str, salt: Column) -> Column:
    """base64 of header, salt and AES-256-CBC ciphertext of ``text``, on a single line."""
    key, iv = key_and_iv(F.lit(password.encode()), salt)
    sealed = F.aes_encrypt(F.encode(text, "UTF-8"), key, F.lit("CBC"), F.lit("PKCS"), iv)
    # aes_encrypt puts the 16 bytes of the IV in front
    body = F.concat(F.lit(SALT_HEADER), salt, F.substring(sealed, 17, 2**31 - 17))
    return F.translate(F.base64(body), "\r\n", "")


def open_salted_aes(sealed: Column, password: str) -> Column:
    """The text that ``salted_aes`` sealed."""
    raw = F.unbase64(sealed)
    key, iv = key_and_iv(F.lit(password.encode()), F.substring(raw, 9, 8))
    plain = F.aes_decrypt(F.concat(iv, F.substring(raw, 17, 2**31 - 17)), key, F.lit("CBC"), F.lit("PKCS"))
    return F.decode(plain, "UTF-8")


def secure_media_path(path: Column, marker: str, password: str, salt: Column) -> Column:
    """Encrypted JSON literal of the part after the marker; paths without marker unchanged."""
    sealed = salted_aes(json_literal(after_marker(path, marker)), password, salt)
    return F.when(path.contains(marker), sealed).otherwise(path)


def stable_id(kind: str, *parts: Column) -> Column:
    """An id for a new row that is the same when a lost task is run again."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts]), 256), 1, 32)
