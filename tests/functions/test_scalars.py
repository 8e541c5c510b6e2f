"""Single values of every function family."""

from datetime import date, datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tesserql.functions import control as c
from tesserql.functions import core
from tesserql.functions import json as j
from tesserql.functions import network as n
from tesserql.functions import numeric as m
from tesserql.functions import regex as r
from tesserql.functions import strings as s
from tesserql.functions import temporal as t
from tests.session import session

session()
L = F.lit
NULL = F.lit(None).cast("string")
DAY = L("2024-02-29").cast("date")
SEEN = L("2021-03-04 15:06:07.089").cast("timestamp")


def ts(x):
    return L(x).cast("timestamp")


def cases(**named):
    return [pytest.param(v[0], v[1], id=k) for k, v in named.items()]


def run_all(spark, params):
    """All expressions in one row, so that one job serves a family."""
    row = spark.range(1).select(*[p.values[0].alias(f"c{k}") for k, p in enumerate(params)]).first()
    wrong = []
    for k, p in enumerate(params):
        got, want = row[k], p.values[1]
        got = bytes(got) if isinstance(got, bytearray) else got
        if isinstance(want, float) and got is not None:
            ok = abs(got - want) < 1e-9
        else:
            ok = got == want and (got is None) == (want is None)
        if not ok:
            wrong.append((p.id, got, want))
    assert not wrong, wrong


def test_core(spark):
    run_all(spark, cases(
        prefix=(core.number_of(L("12abc")), 12.0), none=(core.number_of(L("abc")), 0.0), exp=(core.number_of(L(" -1.5e2x")), -150.0),
        null=(core.number_of(NULL), None), integer=(core.integer_of(L("9.9")), 9), truth=(core.flag(core.truth(L(0.5))), 1),
        xor=(core.flag(core.xor(L(True), L(False))), 1), xor_null=(core.flag(core.xor(L(True), L(None).cast("boolean"))), None),
    ))


def test_strings(spark):
    run_all(spark, cases(
        concat=(s.concat(L("a"), L(1)), "a1"), concat_null=(s.concat(L("a"), NULL), None),
        ws=(s.concat_ws(L(","), L("a"), NULL, L("b")), "a,b"), ws_null=(s.concat_ws(NULL, L("a")), None), ws_none=(s.concat_ws(L(","), NULL), ""),
        length=(s.length(L("é")), 2), chars=(s.char_length(L("é")), 1), bits=(s.bit_length(L("é")), 16),
        bin=(s.bin_(L(12)), "1100"), bin_neg=(s.bin_(L(-1)), "1" * 64), bin_empty=(s.bin_(L("")), None), oct=(s.oct_(L("12x")), "14"),
        hex=(s.hex_number(L(255)), "FF"), hex_round=(s.hex_number(L(D("2.5"))), "3"), hexs=(s.hex_text(L("aé")), "61C3A9"),
        unhex=(s.unhex(L("616263")), b"abc"), odd=(s.unhex(L("F41")), b"\x0fA"), nonhex=(s.unhex(L("GG")), None),
        strcmp=(s.strcmp(L(10), L(9)), -1), strcmp2=(s.strcmp(L("b"), L("a")), 1), strcmp3=(s.strcmp(L("a"), NULL), None),
        sub=(s.substring(L("Quadratically"), L(5)), "ratically"), sub_n=(s.substring(L("Sakila"), L(-5), L(3)), "aki"), sub0=(s.substring(L("abc"), L(0)), ""),
        sub_far=(s.substring(L("abc"), L(-9)), ""), sub_neg=(s.substring(L("abc"), L(1), L(-1)), ""),
        left=(s.left(L("foobar"), L(3)), "foo"), left0=(s.left(L("foobar"), L(-3)), ""), right=(s.right(L("foobar"), L(4)), "obar"), right0=(s.right(L("a"), L(0)), ""),
        lpad=(s.lpad(L("hi"), L(4), L("??")), "??hi"), lpad1=(s.lpad(L("hi"), L(1), L("??")), "h"), lpad_neg=(s.lpad(L("hi"), L(-1), L("?")), None),
        lpad_empty=(s.lpad(L("a"), L(5), L("")), ""), rpad=(s.rpad(L("hi"), L(5), L("?")), "hi???"),
        repeat=(s.repeat(L("ab"), L(2)), "abab"), repeat0=(s.repeat(L("ab"), L(-1)), ""), space=(s.space(L(3)), "   "), reverse=(s.reverse(L("abé")), "éba"),
        ltrim=(s.ltrim(L("  a\t ")), "a\t "), rtrim=(s.rtrim(L(" a  ")), " a"),
        trim=(s.trim(L("xxbarxx"), "x"), "bar"), trim_s=(s.trim(L("barxxyz"), "xyz", "trailing"), "barx"), trim_m=(s.trim(L("ababcab"), "ab"), "c"),
        replace=(s.replace(L("www.my"), L("w"), L("Ww")), "WwWwWw.my"), ascii=(s.ascii_(L("é")), 195), ascii0=(s.ascii_(L("")), 0), ord=(s.ord_(L("é")), 50089),
        locate=(s.locate(L("bar"), L("foobarbar")), 4), locate5=(s.locate(L("bar"), L("foobarbar"), L(5)), 7), locate_none=(s.locate(L("x"), L("foo")), 0),
        locate_ci=(s.locate(L("BAR"), L("foobar"), 1, True), 4), locate_pos0=(s.locate(L("f"), L("foo"), L(0)), 0), instr=(s.instr(L("foobar"), L("bar")), 4),
        insert=(s.insert(L("Quadratic"), L(3), L(4), L("What")), "QuWhattic"), insert_out=(s.insert(L("Quadratic"), L(-1), L(4), L("What")), "Quadratic"),
        insert_all=(s.insert(L("Quadratic"), L(3), L(100), L("What")), "QuWhat"), sidx=(s.substring_index(L("www.my.com"), ".", 2), "www.my"), sidx_n=(s.substring_index(L("www.my.com"), ".", -2), "my.com"),
        quote=(s.quote(L("Don't\\")), "'Don\\'t\\\\'"), quote_null=(s.quote(NULL), "NULL"),
        soundex=(s.soundex(L("Hello")), "H400"), soundex2=(s.soundex(L("Quadratically")), "Q36324"), soundex3=(s.soundex(L("1é")), ""), soundex4=(s.soundex(L("Pfister")), "P236"),
        field=(s.field(L("Bb"), L("Aa"), L("Bb")), 2), field0=(s.field(NULL, L("a")), 0), elt=(s.elt(L(2), L("a"), L("b")), "b"), elt0=(s.elt(L(0), L("a")), None), elt9=(s.elt(L(9), L("a")), None),
        make_set=(s.make_set(L(5), L("a"), L("b"), L("c")), "a,c"), make_null=(s.make_set(L(3), NULL, L("b")), "b"),
        export=(s.export_set(L(5), L("Y"), L("N"), ",", 4), "Y,N,Y,N"), fis=(s.find_in_set(L("b"), L("a,b,c")), 2), fis0=(s.find_in_set(L("a,b"), L("a,b")), 0),
        char=(s.char_(L(77), L(121), NULL), b"My"), char256=(s.char_(L(256)), b"\x01\x00"), char_u=(s.char_using_utf8(L(50089)), "é"),
        format=(s.format_(L(D("12332.1234561")), 4), "12,332.1235"), format0=(s.format_(L(D("2.5")), 0), "3"), conv=(s.conv(L("a"), 16, 2), "1010"),
        b64=(s.to_base64(L("abc")), "YWJj"), b64long=(s.to_base64(L("a" * 60)), "YWFh" * 19 + "\n" + "YWFh"), unb64=(s.from_base64(L("YWJj")), b"abc"), unb64_bad=(s.from_base64(L("!")), None),
        md5=(s.md5(L("testing")), "ae2b1fca515949e5d54fb22b8ed95575"), sha1=(s.sha1(L("abc")), "a9993e364706816aba3e25717850c26c9cd0d89d"), sha2=(s.sha2(L("abc"), 999), None),
        sha224=(s.sha2(L("abc"), 224), "23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7"), crc=(s.crc32(L("abc")), 891568578),
        like=(s.like(L("a%c"), "a\\%_"), 1), like0=(s.like(L("abc"), "A%"), 0), like_ci=(s.like(L("abc\n"), "A%", ignore_case=True), 1), like_e=(s.like(L("a_b"), "a|_b", "|"), 1),
        folded=(core.flag(s.folded(L("É")) == s.folded(L("e"))), 1),
    ))


def test_numbers(spark):
    big = 18446744073709551615
    run_all(spark, cases(
        div=(m.divide(L(1), L(3)), D("0.3333")), div_half=(m.divide(L(2), L(3)), D("0.6667")), div0=(m.divide(L(1), L(0)), None), idiv=(m.div(L(-7), L(2)), -3), idiv0=(m.div(L(7), L(0)), None),
        mod=(m.mod(L(-7), L(3)), -1), mod0=(m.mod(L(7), L(0)), None), inv=(m.bit_not(L(0)), D(big)), shl=(m.shift_left(L(1), 63), D(2**63)), shl64=(m.shift_left(L(1), 64), D(0)), shr=(m.shift_right(L(8), 2), D(2)),
        floor=(m.floor_(L(D("-1.5"))), -2), ceil=(m.ceil_(L(D("1.2"))), 2), floor_d=(m.floor_(L(1.7), True), 1.0),
        round=(m.round_(L(D("2.5"))), D(3)), round_n=(m.round_(L(D("-2.5"))), D(-3)), round_d=(m.round_double(L(2.5)), 2.0), round_d2=(m.round_double(L(150.0), -2), 200.0), round2=(m.round_(L(D("1.298")), 1), D("1.3")),
        trunc=(m.truncate(L(D("1.999")), 1), D("1.9")), trunc_n=(m.truncate(L(-1999), -2), D(-1900)), trunc_d=(m.truncate_double(L(-1.29), 1), -1.2), sign=(m.sign(L(-3.2)), -1),
        greatest=(m.greatest(L(1), L(3)), 3), greatest_null=(m.greatest(L(1), L(None).cast("int")), None), least=(m.least(L(1), L(3)), 1), bit_count=(m.bit_count(L(-1)), 64),
        pi=(m.pi(), 3.141592653589793), log0=(m.ln(L(0)), None), log=(m.log(L(65536), L(2)), 16.0), log1=(m.log(L(8), L(1)), None), log2=(m.log2(L(8)), 3.0), log10=(m.log10(L(-1)), None), sqrt=(m.sqrt(L(-1)), None), acos=(m.acos(L(2)), None),
        atan=(m.atan(L(-2), L(2)), -0.7853981633974483), cot=(m.cot(L(12)), -1.5726734063976893), deg=(m.degrees(m.pi()), 180.0), pow=(m.power(L(2), L(-2)), 0.25), band=(m.bit_and(L(29), L(15)), 13), bor=(m.bit_or(L(29), L(15)), 31), bxor=(m.bit_xor(L(1), L(3)), 2),
        rbytes=(F.octet_length(m.random_bytes(5)), 5),
    ))


def test_control(spark):
    run_all(spark, cases(
        if_=(c.if_number(L(2), L("a"), L("b")), "a"), if0=(c.if_number(L(None).cast("int"), L("a"), L("b")), "b"), ifnull=(c.ifnull(NULL, L("x")), "x"), nullif=(c.nullif(L(1), L(1)), None), isnull=(c.isnull(NULL), 1),
        interval=(c.interval(L(23), L(1), L(15), L(17), L(30)), 3), interval_null=(c.interval(L(None).cast("int"), L(1)), -1), interval0=(c.interval(L(0), L(1)), 0), co=(c.coercibility("literal"), 4), charset=(c.charset(L("a")), "utf8mb4"),
    ))


def test_regex(spark):
    run_all(spark, cases(
        like=(r.regexp_like(L("Michael!"), ".*"), 1), ci=(r.regexp_like(L("CamelCase"), "camelcase", "i"), 1), cs=(r.regexp_like(L("CamelCase"), "camelcase", "ic"), 0),
        instr=(r.regexp_instr(L("dog cat dog"), "dog", 2), 9), instr_o=(r.regexp_instr(L("aa aaa aaaa"), "a{4}"), 8), instr_e=(r.regexp_instr(L("dog cat"), "cat", 1, 1, 1), 8), instr0=(r.regexp_instr(L("dog"), "x"), 0),
        sub=(r.regexp_substr(L("abc def ghi"), "[a-z]+", 1, 3), "ghi"), sub0=(r.regexp_substr(L("abc"), "x"), None),
        rep=(r.regexp_replace(L("a b c"), "b", "X"), "a X c"), rep3=(r.regexp_replace(L("abc def ghi"), "[a-z]+", "X", 1, 3), "abc def X"), rep_pos=(r.regexp_replace(L("abc def"), "[a-z]+", "X", 5), "abc X"), grp=(r.regexp_replace(L("ab"), "(a)(b)", "$2$1"), "ba"),
    ))


def test_temporal(spark):
    run_all(spark, cases(
        add_m=(t.date_add(L("2024-01-31").cast("date"), 1, "MONTH"), date(2024, 2, 29)), add_s=(t.date_add(L("2020-12-31 23:59:59").cast("timestamp"), 1, "SECOND"), datetime(2021, 1, 1)),
        add_h=(t.date_add(DAY, 3, "HOUR"), datetime(2024, 2, 29, 3)), sub_d=(t.date_sub(DAY, 31, "DAY"), date(2024, 1, 29)), add_q=(t.date_add(DAY, 1, "QUARTER"), date(2024, 5, 29)), add_w=(t.date_add(DAY, 1, "WEEK"), date(2024, 3, 7)),
        add_ms=(t.date_add(ts("2100-12-31 23:59:59"), L("1:1"), "MINUTE_SECOND"), datetime(2101, 1, 1, 0, 1)), sub_dh=(t.date_sub(ts("1900-01-01"), L("-1 10"), "DAY_HOUR"), datetime(1900, 1, 2, 10)), sub_ds=(t.date_sub(ts("2025-01-01"), L("1 1:1:1"), "DAY_SECOND"), datetime(2024, 12, 30, 22, 58, 59)),
        add_ym=(t.date_add(DAY, L("1-1"), "YEAR_MONTH"), date(2025, 3, 29)), add_sm=(t.date_add(ts("1992-12-31 23:59:59.000002"), L("1.999999"), "SECOND_MICROSECOND"), datetime(1993, 1, 1, 0, 0, 1, 1)),
        year=(t.year(SEEN), 2021), quarter=(t.quarter(DAY), 1), dow=(t.dayofweek(L("2007-02-03")), 7), wd=(t.weekday(L("2008-02-03")), 6), doy=(t.dayofyear(DAY), 60), bad=(t.year(L("x")), None),
        to_days=(t.to_days(L("2007-10-07")), 733321), from_days=(t.from_days(L(730669)), date(2000, 7, 3)), to_sec=(t.to_seconds(L("2009-11-29")), 63426672000),
        week0=(t.week(L("2008-02-20")), 7), week1=(t.week(L("2008-02-20"), 1), 8), week_53=(t.week(L("2008-12-31"), 1), 53), week00=(t.week(L("2000-01-01"), 0), 0), week2=(t.week(L("2000-01-01"), 2), 52), yw=(t.yearweek(L("1987-01-01")), 198652), yw3=(t.yearweek(L("2000-01-01"), 3), 199952),
        dayname=(t.dayname(L("2007-02-03")), "Saturday"), monthname=(t.monthname(L("2008-02-03")), "February"), last=(t.last_day(L("2003-02-05")), date(2003, 2, 28)),
        hms=(t.time_to_sec(SEEN), 54367), micro=(t.microsecond(SEEN), 89000), ex=(t.extract("YEAR_MONTH", L("2019-07-02")), 201907), ex2=(t.extract("DAY_MINUTE", L("2019-07-02 01:02:03")), 20102), ex3=(t.extract("SECOND_MICROSECOND", SEEN), 7089000),
        fmt=(t.date_format(L("2009-10-04 22:23:00"), "%W %M %Y"), "Sunday October 2009"), fmt2=(t.date_format(L("1900-10-04 22:23:00"), "%D %y %a %d %m %b %j"), "4th 00 Thu 04 10 Oct 277"), fmt3=(t.date_format(L("1997-10-04 22:23:00"), "%H %k %I %r %T %S %w"), "22 22 10 10:23:00 PM 22:23:00 00 6"), fmt4=(t.date_format(L("1999-01-01"), "%X %V"), "1998 52"), fmt5=(t.date_format(DAY, "%%x%q"), "%xq"),
        s2d=(t.str_to_date(L("01,5,2013"), "%d,%m,%Y"), date(2013, 5, 1)), s2t=(t.str_to_date(L("May 1, 2013 09:30"), "%M %d, %Y %H:%i"), datetime(2013, 5, 1, 9, 30)), s2bad=(t.str_to_date(L("x"), "%Y"), None),
        unix=(t.unix_timestamp(L("2015-11-13 10:20:19")), 1447410019), unix0=(t.unix_timestamp(L("x")), 0), unixf=(t.unix_timestamp_micros(L("2015-11-13 10:20:19.012")), D("1447410019.012000")), fromu=(t.from_unixtime(L(1447430881)), datetime(2015, 11, 13, 16, 8, 1)), fromneg=(t.from_unixtime(L(-1)), None),
        tz=(t.convert_tz(L("2004-01-01 12:00:00"), "+00:00", "+10:00"), datetime(2004, 1, 1, 22)), dd=(t.datediff(L("2007-12-31 23:59:59"), L("2007-12-30")), 1), tsd=(t.timestampdiff("MONTH", L("2003-02-01"), L("2003-05-01")), 3), tsdy=(t.timestampdiff("YEAR", L("2002-05-01"), L("2001-01-01")), -1), tsdm=(t.timestampdiff("MINUTE", L("2003-02-01"), L("2003-05-01 12:05:55")), 128885), tsd_part=(t.timestampdiff("MONTH", L("2024-01-31"), L("2024-02-29")), 0),
        td=(t.timediff(L("2000-01-01 00:00:00"), L("2000-01-01 00:00:00.000001")), timedelta(microseconds=-1)), td_max=(t.time_text(t.timediff(L("2000-01-01"), L("1990-01-01"))), "838:59:59"), mk=(t.makedate(L(2011), L(32)), date(2011, 2, 1)), mk0=(t.makedate(L(2011), L(0)), None), mk70=(t.makedate(L(70), L(1)), date(1970, 1, 1)),
        mt=(t.time_text(t.maketime(L(12), L(15), L(30))), "12:15:30"), mtneg=(t.time_text(t.maketime(L(-1), L(15), L(30))), "-01:15:30"), mtbad=(t.maketime(L(1), L(60), L(0)), None), st=(t.time_text(t.sec_to_time(L(2378))), "00:39:38"), pa=(t.period_add(L(200801), L(2)), 200803), pd=(t.period_diff(L(200802), L(200703)), 11), pyy=(t.period_add(L(9912), L(1)), 200001),
        addt=(t.addtime(SEEN, t.maketime(L(1), L(0), L(0))), datetime(2021, 3, 4, 16, 6, 7, 89000)), time=(t.time_text(t.time(SEEN)), "15:06:07"),
    ))
    assert t.get_format("date", "eur") == "%d.%m.%Y"
    assert len(t.UNITS) == 20
    row = spark.range(1).select(t.now().alias("n"), t.curdate().alias("d"), t.curtime().alias("t")).first()
    assert row.n.microsecond == 0 and len(row.t) == 8


def test_weeks_of_all_modes(spark):
    """Against a direct count over two decades."""
    days = spark.sql("SELECT explode(sequence(DATE'1999-12-20', DATE'2012-01-15', INTERVAL 3 DAY)) AS d")
    rows = days.select("d", *[t.week("d", k).alias(f"w{k}") for k in range(8)], *[t.yearweek("d", k).alias(f"y{k}") for k in range(8)]).collect()

    def slow(d, mode):
        monday, ranged, by_weekday = mode % 2 == 1, mode % 4 >= 2, mode in (0, 2, 5, 7)

        def begin(y):
            x = date(y, 1, 1)
            on = x.weekday() if monday else (x.weekday() + 1) % 7
            back = x - timedelta(days=on)
            return back + timedelta(days=7) if (on != 0 if by_weekday else on > 3) else back

        if ranged and d >= begin(d.year + 1):
            return d.year + 1, 1
        if d >= begin(d.year):
            return d.year, (d - begin(d.year)).days // 7 + 1
        return (d.year - 1, (d - begin(d.year - 1)).days // 7 + 1) if ranged else (d.year, 0)

    for row in rows:
        for k in range(8):
            assert row[f"w{k}"] == slow(row.d, k)[1]
            y, w = slow(row.d, k | 2)
            assert row[f"y{k}"] == y * 100 + w
            if k == 3:
                assert (row.d.isocalendar()[0], row.d.isocalendar()[1]) == (y, w)


def test_json(spark):
    doc = L('{"a": {"b": [1, 2, {"c": 3}]}, "bb": null, "d": "x\\"y", "e": 1.50}')
    run_all(spark, cases(
        member=(j.extract(doc, "$.a.b[0]"), "1"), last=(j.extract(doc, "$.a.b[last]"), '{"c": 3}'), range=(j.extract(doc, "$.a.b[0 to 1]"), "[1, 2]"), deep=(j.extract(doc, "$**.c"), "[3]"), wild=(j.extract(doc, "$.a.*"), "[[1, 2, {\"c\": 3}]]"),
        two=(j.extract(doc, "$.a.b[1]", "$.e"), "[2, 1.50]"), none=(j.extract(doc, "$.zz"), None), null=(j.extract(doc, "$.bb"), "null"), wrap=(j.extract(doc, "$.e[0]"), "1.50"), text=(j.extract_text(doc, "$.d"), 'x"y'),
        unq=(j.unquote(L('"a\\tb"')), "a\tb"), unq_plain=(j.unquote(L("abc")), "abc"), arr=(j.array(L(1), L("a"), NULL), '[1, "a", null]'), obj=(j.object_(("bb", L(1)), ("c", L("x")), ("bb", L(2))), '{"c": "x", "bb": 2}'),
        valid=(j.valid(L('{"a":1}')), 1), invalid=(j.valid(L("{a")), 0), valid_null=(j.valid(NULL), None), cont=(j.contains_(doc, L("[2]"), "$.a.b"), 1), cont0=(j.contains_(doc, L('{"a": 1}')), 0), contobj=(j.contains_(L('{"a": {"d": 4}}'), L('{"d": 4}'), "$.a"), 1),
        path1=(j.contains_path(doc, "one", "$.bb", "$.q"), 1), path2=(j.contains_path(doc, "all", "$.bb", "$.q"), 0), over=(j.overlaps_(L("[1,3,5]"), L("[2,5]")), 1), over0=(j.overlaps_(L('{"a":1}'), L('{"a":2}')), 0), over_s=(j.overlaps_(L("[4,5]"), L("5")), 1),
        mem=(j.member_of(L("ab"), L('[23, "abc", "ab"]')), 1), mem0=(j.member_of(L(17), L('[23, "17"]')), 0), t_int=(j.type_(L("12")), "INTEGER"), t_obj=(j.type_(doc), "OBJECT"), t_null=(j.type_(L("null")), "NULL"), t_str=(j.type_(L('"a"')), "STRING"), t_bool=(j.type_(L("true")), "BOOLEAN"),
        len=(j.length(L('[1, 2, {"a": 3}]')), 3), len1=(j.length(L("5")), 1), lenp=(j.length(doc, "$.a.b"), 3), depth=(j.depth_(L('[10, {"a": 20}]')), 3), depth1=(j.depth_(L("[]")), 1), keys=(j.keys(doc), '["a", "d", "e", "bb"]'), keys_p=(j.keys(doc, "$.a.b"), None), normal=(j.normal(L('{"bb":1,"a":[true ,null]}')), '{"a": [true, null], "bb": 1}'),
    ))
    with pytest.raises(ValueError):
        j.legs("$.a**")


def test_network(spark):
    run_all(spark, cases(
        aton=(n.inet_aton(L("10.0.5.9")), 167773449), aton2=(n.inet_aton(L("1.2")), 16777218), aton_bad=(n.inet_aton(L("1.256.1.1")), None), ntoa=(n.inet_ntoa(L(167773449)), "10.0.5.9"), ntoa_bad=(n.inet_ntoa(L(-1)), None),
        v4=(n.is_ipv4(L("10.0.5.9")), 1), v4no=(n.is_ipv4(L("10.0.5.256")), 0), v6=(n.is_ipv6(L("::1")), 1), v6no=(n.is_ipv6(L("10.0.5.9")), 0), six=(s.hex_text(n.inet6_ntoa(n.inet6_aton(L("fdfe::5a55:caff:fefa:9089")))), "666466653A3A356135353A636166663A666566613A39303839"),
        mapped=(n.is_ipv4_mapped(n.inet6_aton(L("::ffff:10.0.5.9"))), 1), compat=(n.is_ipv4_compat(n.inet6_aton(L("::10.0.5.9"))), 1), compat_no=(n.is_ipv4_compat(n.inet6_aton(L("::ffff:10.0.5.9"))), 0), back=(n.inet6_ntoa(n.inet6_aton(L("::ffff:1.2.3.4"))), "::ffff:1.2.3.4"),
        uuid=(n.is_uuid(L("6ccd780c-baba-1026-9564-5b8c656024db")), 1), uuid_b=(n.is_uuid(L("{6ccd780c-baba-1026-9564-5b8c656024db}")), 1), uuid0=(n.is_uuid(L("6ccd780c-baba")), 0),
        u2b=(n.bin_to_uuid(n.uuid_to_bin(L("6ccd780c-baba-1026-9564-5b8c656024db"))), "6ccd780c-baba-1026-9564-5b8c656024db"), swap=(F.hex(n.uuid_to_bin(L("6ccd780c-baba-1026-9564-5b8c656024db"), True)), "1026BABA6CCD780C95645B8C656024DB"), unswap=(n.bin_to_uuid(n.uuid_to_bin(L("6ccd780c-baba-1026-9564-5b8c656024db"), True), True), "6ccd780c-baba-1026-9564-5b8c656024db"),
    ))
