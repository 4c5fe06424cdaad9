"""Private keys with legacy headers are found and masked whole."""

from taskloom.llm import secrets

BODY = "MIIEpAIBAAKCAQEAx+/z\nQ0tQ==\n"
HEADERS = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,ABCDEF\n\n"


def test_pem_with_headers():
    for label in ("RSA ", "EC ", ""):
        key = f"-----BEGIN {label}PRIVATE KEY-----\n{HEADERS}{BODY}-----END {label}PRIVATE KEY-----"
        text = f"a {key} b {key} c"
        assert [(text[x:y], k) for x, y, k in secrets.find(text)] == [(key, "pem")] * 2
        assert secrets.mask(text, secrets.find(text)) == "a [SECRET] b [SECRET] c"
    plain = f"-----BEGIN PRIVATE KEY-----\n{BODY}-----END PRIVATE KEY-----"
    open_ = "-----BEGIN PRIVATE KEY-----\n" + BODY
    assert [(x, k) for x, _, k in secrets.find(open_ + plain)] == [(len(open_), "pem")]
