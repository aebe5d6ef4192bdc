"""The FTP source against a small server of our own."""

import socket
import threading

import pytest

from inkloom.sources import files, ftp, parsers

TREE = {"/": [("dir", "lib", 0), ("file", "a b.txt", 5)], "/lib": [("file", "é.txt", 6), ("file", "gone.txt", 3), ("file", "x.unknown", 1), ("dir", "deep", 0)], "/lib/deep": [("file", "c.rtf", 30)]}
DATA = {"/a b.txt": b"hello", "/lib/é.txt": "szíva".encode(), "/lib/deep/c.rtf": b"{\\rtf1 some text}"}


def serve(connection):
    data = None
    say = lambda line: connection.sendall(f"{line}\r\n".encode())
    say("220 ready")
    for line in connection.makefile("r", encoding="utf-8"):
        word, _, rest = line.strip().partition(" ")
        if word == "USER":
            say("331 password")
        elif word == "PASS":
            say("230 in")
        elif word in ("EPSV", "PASV"):
            data = socket.create_server(("127.0.0.1", 0))
            port = data.getsockname()[1]
            say(f"229 ok (|||{port}|)" if word == "EPSV" else f"227 ok (127,0,0,1,{port // 256},{port % 256})")
        elif word in ("MLSD", "RETR"):
            body = DATA.get(rest) if word == "RETR" else "".join(f"type={k};size={n}; {name}\r\n" for k, name, n in TREE[rest]).encode()
            if body is None:
                say("550 no such file")
                continue
            say("150 comes")
            peer, _ = data.accept()
            peer.sendall(body)
            peer.close()
            say("226 done")
        elif word == "QUIT":
            say("221 bye")
            break
        else:
            say("200 ok")
    connection.close()


@pytest.fixture()
def server():
    listening = socket.create_server(("127.0.0.1", 0))

    def accept():
        while True:
            try:
                connection, _ = listening.accept()
            except OSError:
                return
            threading.Thread(target=serve, args=(connection,), daemon=True).start()

    threading.Thread(target=accept, daemon=True).start()
    yield f"ftp://ada:secret@127.0.0.1:{listening.getsockname()[1]}"
    listening.close()


def test_files_of_a_server(spark, server):
    assert [p for p, _ in ftp.list_tree(server)] == ["/a b.txt", "/lib/gone.txt", "/lib/x.unknown", "/lib/é.txt", "/lib/deep/c.rtf"]
    rows = {r["path"].split("/", 3)[3]: r for r in ftp.walk(spark, server, content=True, partitions=2).collect()}
    assert set(rows) == {"a%20b.txt", "lib/%C3%A9.txt", "lib/gone.txt", "lib/deep/c.rtf"} and not any("secret" in r["path"] for r in rows.values())
    assert bytes(rows["a%20b.txt"]["content"]) == b"hello" and "550" in rows["lib/gone.txt"]["error"] and rows["lib/gone.txt"]["content"] is None
    assert {r["format"] for r in rows.values()} == {"txt", "rtf"}
    parsed = parsers.parse(ftp.walk(spark, f"{server}/lib", content=True))
    assert {(r["text"], r["error"] is None) for r in parsed.collect()} == {("szíva", True), ("some text", True), ("", False)}
    assert ftp.walk(spark, f"{server}/lib/deep").count() == 1 and files.format_of_name("/lib/deep/c.rtf") == "rtf"
