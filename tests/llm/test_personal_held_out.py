"""Precision and recall on texts written without regard to the patterns or to the given tables; each text with its true pieces."""

from tallyloom.llm import personal as P

CASES = [
    ("Please email Joanna at joanna.k@mailhub.org for access.", [("email", "joanna.k@mailhub.org")]),
    ("send logs to: ops-lead_77@sub.domain.co.uk; thanks", [("email", "ops-lead_77@sub.domain.co.uk")]),
    ("my address is p dot novak at uni-east dot edu", [("email", "p dot novak at uni-east dot edu")]),
    ("reach me: tom[at]kiln[dot]dev", [("email", "tom[at]kiln[dot]dev")]),
    ("<a href='mailto:rita@weave.example'>Rita</a>", [("email", "rita@weave.example")]),
    ("git clone git@host.example:team/repo.git", []),
    ("npm i left@1.2.3 right@latest", []),
    ("@decorator\ndef f(x): return x @ y", []),
    ("https://user:secret@db.internal.example/path", []),
    ("see icons@2x.png and logo@3x.jpg", []),
    ("Message-ID: <a8f7.1@relay.example>", []),
    ("noreply@service.example sends these", []),
    ("maintainer = 'Oona Vale <oona@vale.example>'", [("name", "Oona Vale"), ("email", "oona@vale.example")]),
    ("Signed-off-by: Piotr Zając <pz@zajac.example>", [("name", "Piotr Zając"), ("email", "pz@zajac.example")]),
    ("Co-authored-by: Mei-Ling O'Hara <mei@ohara.example>", [("name", "Mei-Ling O'Hara"), ("email", "mei@ohara.example")]),
    ("@author Greta Holm", [("name", "Greta Holm")]),
    ("# Copyright 2011-2014 by Ruben Castell", [("name", "Ruben Castell")]),
    ("# Copyright 2016 The Loom Authors", []),
    ("// Copyright (C) 2020 Northwind Software GmbH", []),
    ("Thanks to Ingrid Solberg and everyone else", [("name", "Ingrid Solberg")]),
    ("Reviewed by T. Okafor", [("name", "T. Okafor")]),
    ("Customer: Lindqvist, Erik", [("name", "Lindqvist, Erik")]),
    ("Dear Paula Reyes,", [("name", "Paula Reyes")]),
    ("TODO: ask Henrik Dahl about this", [("name", "Henrik Dahl")]),
    ("'name': 'Sofia Marin', 'city': 'Porto'", [("name", "Sofia Marin")]),
    ('{"first": "Omar", "last": "Haddad", "phone": "+1 202 555 0143"}', [("name", "Omar"), ("phone", "+1 202 555 0143")]),
    ("Anna Berg,anna@berg.example,+46 8 123 456 78", [("name", "Anna Berg"), ("email", "anna@berg.example"), ("phone", "+46 8 123 456 78")]),
    ("class Big Number extends Base Type", []),
    ("New York and Los Angeles are far apart", []),
    ("Hello World, from Visual Studio", []),
    ("Error Code table; Unit Test plan; Open Source", []),
    ("The Quick Brown Fox", []),
    ("Tel.: (212) 555-0170", [("phone", "(212) 555-0170")]),
    ("call 0161 496 0123 after six", [("phone", "0161 496 0123")]),
    ("Mobil: +49 151 23456789", [("phone", "+49 151 23456789")]),
    ("fax 01 42 68 53 00", [("phone", "01 42 68 53 00")]),
    ("phone=4155550132", [("phone", "4155550132")]),
    ("whatsapp +91-98765-43210", [("phone", "+91-98765-43210")]),
    ("timestamp 1718035200 and size 4294967296", []),
    ("version 10.15.7.2001, build 20240117.3", []),
    ("ISBN 978-3-16-148410-0", []),
    ("sha1 356a192b7913b04c54574d18c28d46e6395428ab", []),
    ("order no 204-119-8830", []),
    ("ip 192.168.100.254:8080", []),
    ("const PI = 3.14159265358979;", []),
    ("range 2000-2500, 100 200 300", []),
    ("SSN 078-05-1120 on file", [("identity_number", "078-05-1120")]),
    ("social security no. 219-09-9999", [("identity_number", "219-09-9999")]),
    ("National Insurance number: AB 12 34 56 C", [("identity_number", "AB 12 34 56 C")]),
    ("passport number: X1234567", [("identity_number", "X1234567")]),
    ("personnummer 19811218-9876", [("identity_number", "19811218-9876")]),
    ("uuid 123e4567-e89b-12d3-a456-426614174000", []),
    ("part number 555-12-3456", []),
    ("He lives at 221 Baker Street, London", [("street_address", "221 Baker Street, London")]),
    ("ship to 1600 Oak Hill Ave., Apt 4", [("street_address", "1600 Oak Hill Ave., Apt 4")]),
    ("Adresse: Goethestraße 12", [("street_address", "Goethestraße 12")]),
    ("12 rue de la Paix", [("street_address", "12 rue de la Paix")]),
    ("Calle Mayor 15", [("street_address", "Calle Mayor 15")]),
    ("5 Open Way connectors", []),
    ("Route 66 and Highway 1", []),
    ("add 3 Drive letters", []),
    ("10 Main Points", []),
]


def counts():
    names = P.NameList([])
    right = found = wanted = 0
    for text, true in CASES:
        got = [(k, text[s:e]) for s, e, k in P.find_personal(text, names)]
        hit = [g for g in got if any(k == g[0] and (g[1] in t or t in g[1]) for k, t in true)]
        right, found, wanted = right + len(hit), found + len(got), wanted + len(true)
    return right, found, wanted


def test_precision_and_recall():
    right, found, wanted = counts()
    assert right / found >= 0.9 and right / wanted >= 0.8, (right, found, wanted)
