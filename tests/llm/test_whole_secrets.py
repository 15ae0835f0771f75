"""A private key is redacted from its BEGIN line to its END line, with its body."""

import pytest

pytest.importorskip("prosegrain.llm")
from prosegrain.llm import secret_scan

BODY = ["MIIEpAIBAAKCAQEA7bq" + "Ab3+/" * 9 for _ in range(25)]
B, E = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
K = "\n".join([*BODY, "Zm9v=="])
CASES = {
    1: (f"before\n{B}\n{K}\n{E}\nafter - it", "before\n<private_key>\nafter - it"),
    2: (f"{B}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011AABB\n\n{K}\n{E}\nafter", "<private_key>\nafter"),
    3: (f"x\n{B}\n{K}\nAnd so on. No end.", "x\n<private_key>\nAnd so on. No end."),
    4: ("-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v2\n\n" + K + "\n=aB3d\n-----END PGP PRIVATE KEY BLOCK-----.", "<private_key>."),
    5: ("a -----BEGIN SSH ENCRYPTED PRIVATE KEY-----\r\n" + K.replace("\n", "\r\n") + "\r\n-----END SSH ENCRYPTED PRIVATE KEY----- b", "a <private_key> b"),
    6: ('{"k": "-----BEGIN PRIVATE KEY-----\\n' + K.replace("\n", "\\n") + '\\n-----END PRIVATE KEY-----\\n", "n": 1}', '{"k": "<private_key>\\n", "n": 1}'),
    7: (f"{B}\n{K}\n{E}\nbetween - them\n{B}\n{K}\n{E}", "<private_key>\nbetween - them\n<private_key>"),
    8: (f"{B} {' '.join(BODY)} and on", "<private_key> and on"),
    9: (f"The line {B} begins a key. It ends - later.", "The line <private_key> begins a key. It ends - later."),
    10: (f"{B}\n" + "\n".join(BODY * 400) + "\nthe end", "<private_key>\nthe end"),
    11: (f"{B}\n  " + "\n  ".join(BODY * 400) + "\n  the end", "<private_key>\n  the end"),
    12: (f"{B}\n" + "Name: a-b\n" * 10_000 + "the - end", None),
}


def test_redaction_leaves_no_body(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secret_scan.redact_documents(docs, length_col=None).collect()}
    for k, (text, want) in CASES.items():
        assert got[k] == want if want else got[k].startswith("<private_key>"), k
