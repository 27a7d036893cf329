"""Secrets of any length, and keys with header lines, are marked whole."""

from stintwise.llm import secrets

PEM = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\nYWJjZGVm\nZ2hp\n-----END RSA PRIVATE KEY-----"


def test_long_passwords_and_encrypted_keys_are_whole(docs_of):
    url = "amqp://" + "u" * 90 + ":" + "P" * 88 + "@"
    many = PEM.replace("Proc-Type", "X-Line: y\n" * 20_000 + "Proc-Type")
    texts = {1: f"see {url}host/x", 2: f"key {PEM} end", 3: f"key {PEM.split('-----END')[0].strip()}", 4: many}
    found, _ = secrets.scan(docs_of(list(texts.items())))
    rows = {r["doc_id"]: {(x["kind"], x["at"], x["until"]) for x in r["found"]} for r in found.collect()}
    assert ("url_password", 4, 4 + len(url)) in rows[1]
    assert ("private_key", 4, 4 + len(PEM)) in rows[2]
    assert ("private_key", 4, len(texts[3])) in rows[3]
    assert ("private_key", 0, len(many)) in rows[4]
