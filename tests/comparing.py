"""Rows of both engines in one comparable form."""

import datetime
import decimal
import math


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat(" ")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    got = con.sql(sql)
    names = sorted(got.columns)
    at = [got.columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
