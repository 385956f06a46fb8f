"""Alert digests per recipient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import QUIEBRE
from ..functions.coerce import blank_to
from .positions import with_group_position

PAGE_ROWS = 500


def settings_with_recipient(settings: DataFrame, users: DataFrame) -> DataFrame:
    """First settings row with the e-mail of its recipient profile, if there is one."""
    first = settings.orderBy("id").limit(1)
    wanted = F.broadcast(first.select(F.col("perfil_destinatario_alertas").alias("username")))
    # One row filters the users where they lie; of a repeated name one address counts.
    emails = users.join(wanted, "username", "left_semi").groupBy("username").agg(
        F.min("correo_electronico").alias("email_destinatario_alertas")
    ).withColumnRenamed("username", "perfil_destinatario_alertas")
    return first.join(emails, "perfil_destinatario_alertas", "left")


def route_alerts(alerts: DataFrame, default_email: str | None) -> DataFrame:
    """Alerts with their recipient: the SKU's own, else the default. Unroutable ones drop out."""
    default = F.nullif(F.lit(default_email).cast("string"), F.lit(""))
    recipient = blank_to(F.col("email_notificacion"), default)
    return alerts.withColumn("destinatario", recipient).filter(F.col("destinatario").isNotNull())


def alerts_by_recipient(routed: DataFrame) -> DataFrame:
    return routed.groupBy("destinatario").agg(F.count(F.lit(1)).alias("n_alertas"))


def _escaped(text: Column) -> Column:
    """The text as it may stand in a page."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _entry() -> Column:
    kind = F.when(F.col("tipo_alerta") == QUIEBRE, "short").otherwise("excess")
    return F.concat(
        F.lit('<li data-kind="'), kind, F.lit('"><code>'), _escaped(F.col("sku")), F.lit("</code> <time>"),
        F.date_format("fecha_proyeccion", "yyyy-MM-dd"), F.lit("</time> "), _escaped(F.col("mensaje")), F.lit("</li>"),
    )


PAGE_START = "<!DOCTYPE html><title>Alertas</title><h1>Alertas de hoy</h1><ol>"
PAGE_END = "</ol>"


def digest_pages(routed: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """HTML digests, in pages of ``page_rows`` alerts ordered by SKU and type.

    One default recipient may receive every alert, so a recipient's digest is
    never built as a single value; each page is.
    """
    placed = with_group_position(
        routed.withColumn("_html", _entry()).select("destinatario", "sku", "tipo_alerta", "_html"),
        ["destinatario"], ["sku", "tipo_alerta"], "_pos",
    )
    page = F.floor(F.col("_pos") / page_rows).cast("int")
    rows = F.array_sort(F.collect_list(F.struct("_pos", "_html")))
    pages = placed.groupBy("destinatario", page.alias("pagina")).agg(
        F.count(F.lit(1)).alias("n_alertas"), rows.alias("_rows")
    )
    body = F.concat_ws("", F.transform("_rows", lambda r: r["_html"]))
    return pages.select(
        "destinatario", "pagina", "n_alertas",
        F.concat(F.lit(PAGE_START), body, F.lit(PAGE_END)).alias("html"),
    )
