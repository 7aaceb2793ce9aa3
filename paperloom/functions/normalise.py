"""Normalisers as column expressions: money, dates, text, payment methods, identifiers, signed amounts, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and keywords.
DATE = r"[0-9]{1,2}\s*[/.-]\s*[0-9]{1,2}\s*[/.-]\s*[0-9]{2,4}"
MONEY = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{1,2})?|[0-9]+\.[0-9]{2}|[0-9]{3,}"
INVOICE = r"[A-Z]{1,4}[0-9]{3,}"
PAYMENT = ("cash", "card", "qr", "visa", "momo", "tien mat", "tiền mặt", "the", "thẻ", "payment", "chuyen khoan")
LABELS = {"qr": "QR", "card": "CARD", "visa": "CARD", "cash": "CASH", "tien mat": "CASH", "tiền mặt": "CASH", "momo": "MOMO"}
VN_LETTERS = (
    "ăâđêôơưĂÂĐÊÔƠƯáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
    "ÁÀẢÃẠẤẦẨẪẬẮẰẲẴẶÉÈẺẼẸẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌỐỒỔỖỘỚỜỞỠỢÚÙỦŨỤỨỪỬỮỰÝỲỶỸỴ"
)


def _first(s: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, 0), F.lit(""))


def norm_money(s: Column) -> Column:
    """First amount once dates are blanked; commas group thousands. Null without one."""
    return F.round(F.replace(_first(F.regexp_replace(F.coalesce(s, F.lit("")), DATE, " "), MONEY), F.lit(","), F.lit("")).try_cast("double"), 2)


def norm_date(s: Column) -> Column:
    """First d/m/y as yyyy-mm-dd, two-digit years in the 2000s; not checked against the calendar."""
    p = F.split(F.regexp_replace(_first(s, DATE), r"\s", ""), "[/.-]")
    y = F.when(F.length(p[2]) == 2, F.concat(F.lit("20"), p[2])).otherwise(F.lpad(p[2], 4, "0"))
    return F.when(p.isNotNull(), F.concat_ws("-", y, F.lpad(p[1], 2, "0"), F.lpad(p[0], 2, "0")))


def norm_text(s: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", " ")), r"\s+", " "))


def norm_payment(s: Column) -> Column:
    """The first keyword, in list order, that the text contains, as its label or in capitals."""

    def label(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for kw in reversed(PAYMENT):
            out = F.when(F.contains(t, F.lit(kw)), F.lit(LABELS.get(kw, kw.upper()))).otherwise(out)
        return out

    return F.get(F.transform(F.array(norm_text(s)), label), 0)  # the text is normalised once, not once a keyword


def norm_invoice(s: Column) -> Column:
    return _first(F.upper(F.coalesce(s, F.lit(""))), INVOICE)


def signed_money(s: Column) -> Column:
    """Amount with the sign of a leading minus, brackets or a word DR; dates are not blanked."""
    t = F.trim(F.coalesce(s, F.lit("")))
    negative = (t.startswith("(") & F.contains(t, F.lit(")"))) | t.startswith("-") | F.upper(t).rlike(r"(?<![\p{L}\p{N}_])DR(?![\p{L}\p{N}_])")
    v = F.round(F.replace(_first(F.replace(t, F.lit(" "), F.lit("")), MONEY), F.lit(","), F.lit("")).try_cast("double"), 2)
    return F.when(negative, -v).otherwise(v)


def account_number(s: Column, least: int = 8) -> Column:
    return _first(F.replace(s, F.lit(" "), F.lit("")), f"[0-9]{{{least},}}")


def diacritic_ratio(s: Column) -> Column:
    n = F.length(s)
    return F.when(n > 0, (n - F.length(F.translate(s, VN_LETTERS, ""))) / n).otherwise(F.lit(0.0))


def cjk_ratio(s: Column) -> Column:
    n = F.length(s)
    return F.when(n > 0, (n - F.length(F.regexp_replace(s, "[一-鿿　-〿]", ""))) / n).otherwise(F.lit(0.0))
