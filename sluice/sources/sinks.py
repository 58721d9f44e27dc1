"""Payloads for other systems, as columns; what sends them is passed in."""

from __future__ import annotations

import re
from collections.abc import Callable
from email.message import EmailMessage

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import col, kind_of
from ..plans.lexer import QueryError


def kafka_payload(df: DataFrame, run_time: str, app_id: str) -> DataFrame:
    """(value): each row as JSON, with when and by which application it was made."""
    row = F.struct(*[col(c) for c in df.columns], F.lit(run_time).alias("save_runTime"), F.lit(app_id).alias("save_appId"))
    return df.select(F.to_json(row).alias("value"))


def save_to_kafka(df: DataFrame, topic: str, options: dict[str, str], run_time: str) -> None:
    kafka_payload(df, run_time, df.sparkSession.sparkContext.applicationId).write.format("kafka").options(**options).option("topic", topic).save()


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r'(["\\\]])', r"\\$1")


def syslog_lines(df: DataFrame, hostname: str = "localhost", app: str = "sluice", element: str = "fields@32473", facility: int = 1, severity: int = 6) -> DataFrame:
    """(line): RFC 5424, _time as time stamp, _raw as message, all other columns as structured data."""
    at = F.date_format(col("_time"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if "_time" in df.columns else F.lit("-")
    message = col("_raw").cast("string") if "_raw" in df.columns else F.lit("")
    others = [c for c in df.columns if c not in ("_time", "_raw")]
    params = [F.when(col(c).isNotNull(), F.concat(F.lit(" " + re.sub(r'[\s=\]"]', "_", c)[:32] + '="'), _escaped(F.to_json(F.struct(col(c))) if kind_of(df.schema[c].dataType) in ("mv", "other") else col(c).cast("string")), F.lit('"'))) for c in others]
    data = F.concat(F.lit(f"[{element}"), F.concat_ws("", *params), F.lit("]")) if params else F.lit("-")
    return df.select(F.concat(F.lit(f"<{facility * 8 + severity}>1 "), at, F.lit(f" {hostname} {app} - - "), data, F.lit(" "), F.coalesce(message, F.lit(""))).alias("line"))


_CALL = re.compile(r"(\w+)\((.*)\)$")


def metric_lines(df: DataFrame, key: str) -> DataFrame:
    """(line): a metric for each row. Columns min(..), max(..), sum(..) and count(..) are the parts of a gauge, other f(..) a value each, _time the
    time, all others dimensions."""
    parts, dims = {}, []
    for c in df.columns:
        m = _CALL.match(c)
        if c == "_time":
            continue
        if m and m[1] in ("min", "max", "sum", "count"):
            parts[m[1]] = col(c)
        elif m:
            parts.setdefault(m[1], col(c))
        else:
            dims.append(c)
    if not parts:
        raise QueryError("a metric needs an aggregate")
    gauge = F.concat_ws(",", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in parts.items()])
    tags = F.concat_ws("", *[F.when(col(c).isNotNull(), F.concat(F.lit("," + re.sub(r"[^a-z0-9_.-]", "_", c.lower()) + '="'), _escaped(col(c).cast("string")), F.lit('"'))) for c in dims])
    at = F.concat(F.lit(" "), F.unix_millis(col("_time")).cast("string")) if "_time" in df.columns else F.lit("")
    return df.select(F.concat(F.lit(key), tags, F.lit(" gauge,"), gauge, at).alias("line"))


def send_lines(df: DataFrame, open_sender: Callable[[], Callable[[str], None]]) -> None:
    """Each partition's lines to a sender of its own."""

    def run(rows) -> None:
        send = open_sender()
        for r in rows:
            send(r[0])

    df.foreachPartition(run)


def to_kafka(payload: DataFrame, options: dict[str, str]) -> None:
    payload.write.format("kafka").option("kafka.bootstrap.servers", options.get("servers", "localhost:9092")).option("topic", options["topic"]).save()


def to_syslog(lines: DataFrame, options: dict[str, str]) -> None:
    """Over TCP, a connection for each partition, lines framed by their length (RFC 6587); a lost connection is opened anew, up to ten times."""
    host, port = options.get("host", "localhost"), int(options.get("port", 1601))

    def open_sender() -> Callable[[str], None]:
        import socket
        import time

        held: list = []

        def send(line: str) -> None:
            raw = (line or "").encode()
            for left in range(9, -1, -1):
                try:
                    if not held:
                        held.append(socket.create_connection((host, port), 10))
                    held[0].sendall(b"%d %s" % (len(raw), raw))
                    return
                except OSError:
                    if held:
                        held.pop().close()
                    if not left:
                        raise
                    time.sleep(0.5)

        return send

    send_lines(lines, open_sender)


#: Metric lines of one request.
METRIC_LINES = 1000


def to_metrics(lines: DataFrame, options: dict[str, str]) -> None:
    """POSTs to the endpoint in requests of METRIC_LINES lines. 202 is success; any other answer is an error that tells what the endpoint says."""
    url = options.get("url", "http://localhost:14499/metrics/ingest")

    def run(rows) -> None:
        from itertools import islice
        from urllib import error, request

        while part := [r[0] for r in islice(rows, METRIC_LINES)]:
            post = request.Request(url, "\n".join(part).encode(), {"Content-Type": "text/plain; charset=utf-8"})
            try:
                with request.urlopen(post, timeout=30) as answer:
                    status, said = answer.status, answer.read(2000).decode(errors="replace")
            except error.HTTPError as e:
                status, said = e.code, e.read(2000).decode(errors="replace")
            if status != 202:
                raise QueryError(f"the metric endpoint answers {status}: {said}")

    lines.foreachPartition(run)


def to_jdbc(filters: DataFrame, options: dict[str, str]) -> None:
    """Filters to a table: create appends, update writes it anew. Without a URL they are only the result."""
    if "url" in options:
        filters.write.format("jdbc").option("url", options["url"]).option("dbtable", options.get("table", "filters")).mode("overwrite" if options.get("mode") == "update" else "append").save()


#: What sends a payload where the engine is given nothing else.
SENDERS: dict[str, Callable[[DataFrame, dict[str, str]], None]] = {"kafka": to_kafka, "syslog": to_syslog, "metric": to_metrics, "bloom": to_jdbc}


def as_table(columns: list[str], rows: list[tuple], sort_widths: bool = False) -> str:
    cells = [["" if x is None else str(x) for x in r] for r in rows]
    order = list(range(len(columns)))
    width = [max([len(columns[i]), *(len(r[i]) for r in cells)]) for i in order]
    if sort_widths:
        order.sort(key=lambda i: width[i])
    line = lambda r: "  ".join(r[i].ljust(width[i]) for i in order).rstrip()
    return "\n".join([line(columns), line(["-" * w for w in width]), *map(line, cells)])


def as_csv(columns: list[str], rows: list[tuple]) -> str:
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows([["" if x is None else x for x in r] for r in rows])
    return out.getvalue()


def as_html(columns: list[str], rows: list[tuple]) -> str:
    from html import escape

    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape('' if c is None else str(c))}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + row(columns, "th") + "".join(row(r, "td") for r in rows) + "</table>"


UNSUPPORTED_MAIL = ("maxtime", "pdfview", "priority", "sendpdf")


def build_mail(df: DataFrame, options: dict[str, str], restricted: bool = False) -> EmailMessage | None:
    """The message with the results, or None if there are none. Of these at most maxinputs rows come to the driver."""
    if "to" not in options:
        raise QueryError("sendemail needs to")
    for name in UNSUPPORTED_MAIL:
        if name in options and (name != "sendpdf" or _on(options[name])):
            raise QueryError(f"sendemail doesn't support {name}")
    if restricted and (extra := set(options) - {"to", "subject"}):
        raise QueryError(f"sendemail may only have to and subject here, not {', '.join(sorted(extra))}")
    if _on(options.get("use_tls")) and _on(options.get("use_ssl")):
        raise QueryError("sendemail takes use_tls or use_ssl, not both")
    form = options.get("format", "table")
    if form not in ("table", "raw", "csv"):
        raise QueryError(f"sendemail has no format {form}")
    rows = [tuple(r) for r in df.limit(int(options.get("maxinputs", 50000))).collect()]
    if not rows:
        return None
    mail = EmailMessage()
    mail["To"], mail["From"] = options["to"], options.get("from", "sluice@localhost")
    for k in ("cc", "bcc"):
        if k in options:
            mail[k.capitalize()] = options[k]
    mail["Subject"] = options.get("subject", "Search results")
    html = options.get("content_type", "html").lower() == "html"
    body = [options.get("message", "Search complete.")]
    if _on(options.get("sendresults")) and _on(options.get("inline", "true")):
        if form == "csv":
            body.append(as_csv(df.columns, rows))
        elif form == "raw":
            at = df.columns.index("_raw") if "_raw" in df.columns else 0
            body.append("\n".join("" if r[at] is None else str(r[at]) for r in rows))
        else:
            body.append(as_html(df.columns, rows) if html else as_table(df.columns, rows, _on(options.get("width_sort_columns", "true"))))
    if "footer" in options:
        body.append(options["footer"])
    mail.set_content("\n\n".join(body), subtype="html" if html else "plain")
    if _on(options.get("sendcsv")) or _on(options.get("sendresults")) and not _on(options.get("inline", "true")):
        mail.add_attachment(as_csv(df.columns, rows), subtype="csv", filename="results.csv")
    return mail


def send_mail(mail: EmailMessage, options: dict[str, str]) -> None:
    import smtplib

    host, _, port = options.get("server", "localhost:25").partition(":")
    with (smtplib.SMTP_SSL if _on(options.get("use_ssl")) else smtplib.SMTP)(host, int(port or 25)) as s:
        if _on(options.get("use_tls")):
            s.starttls()
        s.send_message(mail)


def _on(value: str | None) -> bool:
    return (value or "f").lower() in ("t", "true", "1")
