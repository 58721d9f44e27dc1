import json
import time

import pytest

from sluice.engine import Engine
from sluice.plans.lexer import QueryError


def sent(spark, events, query):
    kept = {}
    senders = {k: (lambda payload, options, k=k: kept.update({k: (payload, options)})) for k in ("kafka", "syslog", "metric", "bloom", "mail")}
    Engine(spark, source=events, senders=senders).run(query)
    return kept


def test_kafka(spark, events):
    payload, options = sent(spark, events, "index=* offset=1 | fields offset index | p exec kafka save topic1")["kafka"]
    row = json.loads(payload.first()["value"])
    assert row["offset"] == 1 and row["index"] == "idx_a" and "save_appId" in row and options["topic"] == "topic1"


def test_syslog(spark, events):
    payload, options = sent(spark, events, "index=* offset=1 | fields _time _raw index | p exec syslog stream host h port 601")["syslog"]
    assert payload.first()["line"] == '<14>1 2023-01-01T00:00:00.000000Z localhost sluice - - [fields@32473 index="idx_a"] raw 01'
    assert options == {"host": "h", "port": "601"}
    with pytest.raises(QueryError, match="after aggregations"):
        sent(spark, events, "index=* | stats count | p exec syslog stream")


def test_metric(spark, events):
    payload, _ = sent(spark, events, 'index=* | stats min(offset) max(offset) BY index | p exec dynatrace metric write "k"')["metric"]
    assert payload.first()["line"] == 'k,index="idx_a" gauge,min=1,max=5'
    with pytest.raises(QueryError, match="requires a preceding aggregate"):
        sent(spark, events, "index=* | p exec dynatrace metric write")


def test_mail(spark, events):
    mail, options = sent(spark, events, 'index=* offset<3 | fields offset _raw | sendemail to="a@b.c" subject="S" sendresults=true inline=true content_type=plain footer="bye" server="h:2525"')["mail"]
    assert mail["To"] == "a@b.c" and mail["Subject"] == "S" and options["server"] == "h:2525"
    body = mail.get_content()
    assert "raw 01" in body and body.rstrip().endswith("bye")
    mail, _ = sent(spark, events, 'index=* offset<3 | fields offset | sendemail to="a@b.c" sendresults=true inline=false')["mail"]
    assert [p.get_filename() for p in mail.iter_attachments()] == ["results.csv"]
    assert "mail" not in sent(spark, events, 'index=* offset>99 | sendemail to="a@b.c"')


@pytest.mark.parametrize("options", ["subject=x", "to=a use_tls=true use_ssl=true", "to=a maxtime=5", "to=a format=xml"])
def test_mail_errors(spark, events, options):
    with pytest.raises(QueryError):
        sent(spark, events, f"index=* | sendemail {options}")


def test_restricted_mail(spark, events):
    with pytest.raises(QueryError):
        Engine(spark, source=events, restricted_mail=True).run("index=* | sendemail to=a cc=b")


def test_syslog_over_a_socket(spark, events):
    import socketserver
    import threading

    got = []

    class Handler(socketserver.StreamRequestHandler):
        def handle(self):
            while size := b"".join(iter(lambda: self.rfile.read(1).strip(), b"")):
                got.append(self.rfile.read(int(size)).decode())

    with socketserver.ThreadingTCPServer(("127.0.0.1", 0), Handler) as server:
        server.daemon_threads = True
        threading.Thread(target=server.serve_forever, daemon=True).start()
        Engine(spark, source=events).run(f"index=* | fields _raw offset | x exec syslog stream host 127.0.0.1 port {server.server_address[1]}")
        deadline = time.time() + 10
        while len(got) < 10 and time.time() < deadline:
            time.sleep(0.1)
        server.shutdown()
    assert sorted(line.rsplit("] ", 1)[1] for line in got) == [f"raw {i:02d}" for i in range(1, 11)]


@pytest.mark.parametrize("status", [202, 400])
def test_metrics_over_http(spark, events, status):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(self.rfile.read(int(self.headers["Content-Length"])).decode())
            self.send_response(status)
            self.end_headers()
            self.wfile.write(b"linesInvalid")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    query = f'index=* | stats count(offset) BY sourcetype | x exec dynatrace metric write "m" url "http://127.0.0.1:{server.server_address[1]}/x"'
    try:
        if status == 202:
            Engine(spark, source=events).run(query)
            assert sorted("\n".join(got).split("\n")) == ['m,sourcetype="stream1" gauge,count=5', 'm,sourcetype="stream2" gauge,count=5']
        else:
            with pytest.raises(Exception, match="answers 400: linesInvalid"):
                Engine(spark, source=events).run(query)
    finally:
        server.shutdown()
