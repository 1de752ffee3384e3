"""The queries of catalogue.py as SQL, written from the definitions: two-dimensional kernels over joins, no windows."""

from __future__ import annotations

RAW = "SELECT CAST(l_linenumber AS INT)-1 AS frame_idx, CAST(l_orderkey % 32 AS INT) AS y, CAST(l_partkey % 32 AS INT) AS x"
GRID = """grid AS (SELECT frame_idx,y,x FROM (SELECT DISTINCT frame_idx FROM raw) a CROSS JOIN (SELECT DISTINCT y FROM raw) b CROSS JOIN (SELECT DISTINCT x FROM raw) c)"""
GREY = f"""raw AS ({RAW}, CAST(FLOOR(AVG(l_quantity)*5) AS INT) AS v FROM lineitem GROUP BY 1,2,3), {GRID},
f AS (SELECT g.frame_idx,g.y,g.x,CAST(COALESCE(r.v,0) AS DOUBLE) AS v FROM grid g LEFT JOIN raw r ON g.frame_idx=r.frame_idx AND g.y=r.y AND g.x=r.x)"""
RGB = f"""raw AS ({RAW}, CAST(FLOOR(AVG(l_quantity)*5) AS INT) AS r, CAST(FLOOR(AVG(ROUND(l_discount*100))*25) AS INT) AS g, CAST(FLOOR(AVG(ROUND(l_tax*100))*30) AS INT) AS b FROM lineitem GROUP BY 1,2,3), {GRID},
rgb AS (SELECT g.frame_idx,g.y,g.x,COALESCE(r.r,0) AS r,COALESCE(r.g,0) AS g,COALESCE(r.b,0) AS b FROM grid g LEFT JOIN raw r ON g.frame_idx=r.frame_idx AND g.y=r.y AND g.x=r.x)"""
STACKS = """num AS (SELECT label AS stack_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS INT) AS frame_idx, embedding FROM embeddings),
cells AS (SELECT stack_id, frame_idx, unnest(embedding) AS e, generate_subscripts(embedding,1)-1 AS p FROM num),
s AS (SELECT stack_id, frame_idx, CAST(p//8 AS INT) AS y, CAST(p%8 AS INT) AS x, CAST(FLOOR((CAST(e AS DOUBLE)+1)*127.5) AS DOUBLE) AS v FROM cells)"""
STEPS = """st AS (SELECT n_regionkey AS stack_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)-1 AS INT) AS frame_idx,
 1+CAST(n_nationkey%3-1 AS DOUBLE)/1024 AS a00, CAST(n_nationkey%2 AS DOUBLE)/2048 AS a01, CAST(n_nationkey%5-2 AS DOUBLE) AS tx,
 0-CAST(n_nationkey%2 AS DOUBLE)/2048 AS a10, 1+CAST(n_nationkey%3-1 AS DOUBLE)/1024 AS a11, CAST(n_nationkey*3%7-3 AS DOUBLE) AS ty FROM nation)"""
FILES = """files AS (SELECT CONCAT('img_', CAST(doc_id AS VARCHAR), CASE doc_id % 8 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.png' WHEN 3 THEN '.TIF'
 WHEN 4 THEN '.tiff' WHEN 5 THEN '.webp' WHEN 6 THEN '.gif' ELSE '.txt' END) AS path FROM documents),
img AS (SELECT path, lower(regexp_extract(path, '(\\.[a-zA-Z]+)$', 1)) AS ext FROM files)"""
SUPPORTED = "ext IN ('.jpg','.jpeg','.png','.tif','.tiff','.webp')"


def mirror(i: str, n: int | str) -> str:
    """The place that i is mirrored to, edge doubled; up to one length outside."""
    return f"CASE WHEN {i}<0 THEN -1-({i}) WHEN {i}>=({n}) THEN 2*({n})-1-({i}) ELSE {i} END"


def mirror_101(i: str, n: int) -> str:
    return f"CASE WHEN {i}<0 THEN -({i}) WHEN {i}>={n} THEN 2*{n}-2-({i}) ELSE {i} END"


def kernel(taps, first: int | None = None) -> str:
    first = -(len(taps) // 2) if first is None else first
    return "(VALUES " + ",".join(f"({o},CAST({w!r} AS DOUBLE))" for o, w in enumerate(taps, first) if w) + ")"


def conv(src: str, keys: str, h: int, w: int, ky: str, kx: str, value: str = "s.v", agg: str = "SUM(k.w*l.w*{v})", name: str = "v", stride: int = 1, border=mirror) -> str:
    """A two-dimensional filter of src."""
    on = " AND ".join(f"s.{k}=p.{k}" for k in keys.split(","))
    at = ",".join(f"p.{k}" for k in keys.split(","))
    out = (f"p.y//{stride}", f"p.x//{stride}") if stride > 1 else ("p.y", "p.x")
    where = f"WHERE p.y%{stride}=0 AND p.x%{stride}=0" if stride > 1 else ""
    return f"""(SELECT {at}, CAST({out[0]} AS INT) AS y, CAST({out[1]} AS INT) AS x, {agg.format(v=value)} AS {name}
 FROM {src} p CROSS JOIN {ky} k(o,w) CROSS JOIN {kx} l(o,w) JOIN {src} s ON {on} AND s.y={border('p.y+k.o', h)} AND s.x={border('p.x+l.o', w)} {where} GROUP BY ALL)"""


BIN = kernel([w / 16 for w in (1, 4, 6, 4, 1)])
BIN2 = kernel([w / 8 for w in (1, 4, 6, 4, 1)])
ONE3 = kernel([1, 1, 1])


def reduce_sql(src: str, keys: str, h: int, w: int) -> str:
    return conv(src, keys, h, w, BIN, BIN, stride=2)


def expand_sql(src: str, keys: str, h: int, w: int, to_h: int, to_w: int) -> str:
    """h x w pixels to to_h x to_w."""
    on = " AND ".join(f"s.{k}=p.{k}" for k in keys.split(","))
    yy, xx = mirror("p.y+k.o", 2 * h), mirror("p.x+l.o", 2 * w)
    return f"""(SELECT {','.join('p.' + k for k in keys.split(','))}, p.y, p.x, SUM(k.w*l.w*s.v) AS v
 FROM (SELECT DISTINCT {keys}, CAST(ys.y AS INT) AS y, CAST(xs.x AS INT) AS x FROM {src} CROSS JOIN range({to_h}) ys(y) CROSS JOIN range({to_w}) xs(x)) p
 CROSS JOIN {BIN2} k(o,w) CROSS JOIN {BIN2} l(o,w) JOIN {src} s ON {on} AND 2*s.y={yy} AND 2*s.x={xx} GROUP BY ALL)"""


def pyramid_ctes(src: str, keys: str, h: int, w: int, levels: int, p: str = "") -> str:
    """CTEs {p}b0.. (bands) and {p}b<levels> (the rest)."""
    out, now = [], src
    on = " AND ".join(f"a.{k}=g.{k}" for k in [*keys.split(","), "y", "x"])
    for i in range(levels):
        nh, nw = (h + 1) // 2, (w + 1) // 2
        out.append(f"{p}r{i} AS {reduce_sql(now, keys, h, w)}")
        out.append(f"{p}e{i} AS {expand_sql(f'{p}r{i}', keys, nh, nw, h, w)}")
        out.append(f"{p}b{i} AS (SELECT {','.join('a.' + k for k in keys.split(','))}, a.y, a.x, a.v-g.v AS v FROM {now} a JOIN {p}e{i} g ON {on})")
        now, h, w = f"{p}r{i}", nh, nw
    out.append(f"{p}b{levels} AS (SELECT {keys}, y, x, v FROM {now})")
    return ",\n".join(out)


def collapse_ctes(prefix: str, keys: str, h: int, w: int, levels: int, out: str) -> str:
    """From bands {prefix}0..levels to the image {out}; keys may be empty."""
    keys = keys or "one"
    size = [(h, w)]
    for _ in range(levels):
        size.append(((size[-1][0] + 1) // 2, (size[-1][1] + 1) // 2))
    ctes, now = [], f"{prefix}{levels}"
    on = " AND ".join(f"a.{k}=g.{k}" for k in [*keys.split(","), "y", "x"])
    for i in reversed(range(levels)):
        ctes.append(f"{out}u{i} AS {expand_sql(now, keys, *size[i + 1], *size[i])}")
        ctes.append(f"{out}c{i} AS (SELECT {','.join('a.' + k for k in keys.split(','))}, a.y, a.x, a.v+g.v AS v FROM {prefix}{i} a JOIN {out}u{i} g ON {on})")
        now = f"{out}c{i}"
    ctes.append(f"{out} AS (SELECT * FROM {now})")
    return ",\n".join(ctes)


def energy_sql(src: str, keys: str, h: int, w: int) -> str:
    return conv(src, keys, h, w, ONE3, ONE3, "s.v*s.v", "SUM({v})/9", "e")


def deviation_sql(src: str, keys: str, h: int, w: int) -> str:
    return conv(src, keys, h, w, ONE3, ONE3, "s.v", "SQRT(GREATEST(AVG({v}*{v})-AVG({v})*AVG({v}),0))", "d")


def entropy_sql(src: str, keys: str, h: int, w: int) -> str:
    k8 = kernel([1] * 8, -4)
    scaled = f"(SELECT {keys},y,x,(v-MIN(v) OVER (PARTITION BY {keys}))/(MAX(v) OVER (PARTITION BY {keys})-MIN(v) OVER (PARTITION BY {keys})+1e-10) AS v FROM {src})"
    bits = f"(SELECT {keys},y,x,0.0-v*LOG2(v+1e-10)-(1-v)*LOG2(1-v+1e-10) AS v FROM {scaled})"
    return conv(bits, keys, h, w, k8, k8, "s.v", "SUM({v})/64", "h")


def weight_ctes(prefix: str, keys: str, h: int, w: int, levels: int, sharpness: float, out: str) -> str:
    ctes = []
    for i in range(levels):
        ctes.append(f"{out}{i} AS (SELECT {keys},y,x,POW(e,{sharpness}) AS e FROM {energy_sql(f'{prefix}{i}', keys, h, w)})")
        h, w = (h + 1) // 2, (w + 1) // 2
    on = " AND ".join(f"a.{k}=b.{k}" for k in [*keys.split(","), "y", "x"])
    ctes.append(f"{out}d AS {deviation_sql(f'{prefix}{levels}', keys, h, w)}")
    ctes.append(f"{out}h AS {entropy_sql(f'{prefix}{levels}', keys, h, w)}")
    ctes.append(f"{out}{levels} AS (SELECT {','.join('a.' + k for k in keys.split(','))},a.y,a.x,POW((a.d+b.h)*0.5,{sharpness}) AS e FROM {out}d a JOIN {out}h b ON {on})")
    return ",\n".join(ctes)


def sum_ctes(bands: str, weights: str, keys: str, on: str, levels: int, out: str) -> str:
    """keys: what stays (may be empty); on: what joins weights to bands."""
    own = "".join(f"b.{k}," for k in keys.split(",")) if keys else "1 AS one,"
    cond = " AND ".join(f"b.{k}=w.{k}" for k in [*on.split(","), "y", "x"])
    return ",\n".join(f"{out}{i} AS (SELECT {own}b.y,b.x,SUM(w.e) AS se,SUM(w.e*b.v) AS sex,SUM(b.v) AS sx,COUNT(*) AS n FROM {bands}{i} b JOIN {weights}{i} w ON {cond} GROUP BY ALL)" for i in range(levels + 1))


ALPHA = "LEAST(GREATEST((LOG10(se+1e-40)+20)/12,0.0),1.0)"


def final_ctes(sums: str, keys: str, levels: int, out: str) -> str:
    return ",\n".join(f"{out}{i} AS (SELECT {keys or 'one'},y,x,{ALPHA}*sex/(se+1e-40)+(1-{ALPHA})*sx/n AS v FROM {sums}{i})" for i in range(levels + 1))


def fuse_ctes(src: str, keys: str, stay: str, h: int, w: int, levels: int, out: str, light: str | None = None, light_keys: str | None = None) -> str:
    p = out + "_"
    parts = [pyramid_ctes(src, keys, h, w, levels, p)]
    if light:
        parts.append(pyramid_ctes(light, light_keys, h, w, levels, p + "l"))
    parts.append(weight_ctes(f"{p}lb" if light else f"{p}b", light_keys or keys, h, w, levels, 4.0, p + "w"))
    parts.append(sum_ctes(f"{p}b", p + "w", stay, light_keys or keys, levels, p + "s"))
    parts.append(final_ctes(p + "s", stay, levels, p + "f"))
    parts.append(collapse_ctes(p + "f", stay, h, w, levels, out))
    return ",\n".join(parts)


def union_levels(prefix: str, levels: int, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS level,{columns} FROM {prefix}{i}" for i in range(levels + 1))


def gauss(size: int) -> list[float]:
    import math

    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma**2)) for i in range(size)]
    return [x / sum(w) for x in w]


def blur_sql(src: str, keys: str, n: int, size: int) -> str:
    """In two passes, as 31 x 31 taps would be slow."""
    k, one = kernel(gauss(size)), "(VALUES (0,1.0))"
    return conv(conv(src, keys, n, n, one, k, border=mirror_101), keys, n, n, k, one, border=mirror_101)


def sobel_ctes(src: str, out: str) -> str:
    d, s = kernel([-1, -2, 0, 2, 1]), kernel([1, 4, 6, 4, 1])
    gx, gy = (conv(src, "frame_idx", 32, 32, a, b, border=mirror_101) for a, b in ((s, d), (d, s)))
    return f"{out}x AS {gx}, {out}y AS {gy}, {out} AS (SELECT a.frame_idx,a.y,a.x,a.v*a.v+b.v*b.v AS e FROM {out}x a JOIN {out}y b USING (frame_idx,y,x))"


UNIT = "u AS (SELECT frame_idx,y,x,v/255.0 AS v FROM f)"
LAPLACE = """(SELECT p.frame_idx,p.y,p.x,SUM(k.w*s.v) AS v FROM f p CROSS JOIN (VALUES (-1,-1,2.0),(-1,1,2.0),(1,-1,2.0),(1,1,2.0),(0,0,-8.0)) k(dy,dx,w)
 JOIN f s ON s.frame_idx=p.frame_idx AND s.y=""" + mirror_101("p.y+k.dy", 32) + " AND s.x=" + mirror_101("p.x+k.dx", 32) + " GROUP BY ALL)"
ELLIPSE = ",".join(f"({dy},{dx})" for dy, w in zip(range(-3, 4), (0, 2, 3, 3, 3, 2, 0), strict=True) for dx in range(-w, w + 1))


def dilate_sql(src: str) -> str:
    return f"(SELECT p.frame_idx,p.y,p.x,MAX(s.v) AS v FROM {src} p CROSS JOIN (VALUES {ELLIPSE}) k(dy,dx) JOIN {src} s ON s.frame_idx=p.frame_idx AND s.y=p.y+k.dy AND s.x=p.x+k.dx GROUP BY ALL)"


TILES = f"""{GREY}, cnt AS (SELECT frame_idx,y//16 AS ty,x//16 AS tx,CAST(v AS INT) AS v,COUNT(*) AS c FROM f GROUP BY ALL),
ov AS (SELECT frame_idx,ty,tx,SUM(GREATEST(c-2,0)) AS o FROM cnt GROUP BY ALL),
full_ AS (SELECT ov.*,CAST(g.v AS INT) AS v FROM ov CROSS JOIN range(256) g(v)),
hist AS (SELECT a.frame_idx,CAST(a.ty AS INT) AS ty,CAST(a.tx AS INT) AS tx,a.v,CAST(LEAST(COALESCE(c.c,0),2)+a.o//256+CASE WHEN a.o%256>0 AND a.v%GREATEST(256//GREATEST(a.o%256,1),1)=0 AND a.v//GREATEST(256//GREATEST(a.o%256,1),1)<a.o%256 THEN 1 ELSE 0 END AS BIGINT) AS n
 FROM full_ a LEFT JOIN cnt c ON a.frame_idx=c.frame_idx AND a.ty=c.ty AND a.tx=c.tx AND a.v=c.v),
lut AS (SELECT frame_idx,ty,tx,v,CAST(LEAST(FLOOR(SUM(n) OVER (PARTITION BY frame_idx,ty,tx ORDER BY v)*255.0/256+0.5),255) AS INT) AS lut FROM hist)"""

MASK = f"""lap AS (SELECT frame_idx,y,x,v*v AS v FROM {LAPLACE}), sh AS (SELECT frame_idx,y,x,ROUND(v,6) AS v FROM {blur_sql('lap', 'frame_idx', 32, 15)}),
cut AS (SELECT frame_idx,percentile_cont(0.3) WITHIN GROUP (ORDER BY v) AS c FROM sh GROUP BY 1),
ov AS (SELECT sh.frame_idx,y,x,CASE WHEN v>=c-1e-7 THEN 1.0 ELSE 0.0 END AS v FROM sh JOIN cut ON sh.frame_idx=cut.frame_idx),
mask AS (SELECT frame_idx,y,x,CAST(v AS INT) AS mask FROM {dilate_sql('ov')})"""

SCORES = f"""{STACKS}, sc AS (SELECT stack_id,frame_idx,(64*SUM(v*v)-SUM(v)*SUM(v))/CAST(409600 AS DOUBLE) AS score FROM s GROUP BY 1,2),
rk AS (SELECT *,row_number() OVER (PARTITION BY stack_id ORDER BY score DESC,frame_idx) AS rn,COUNT(*) FILTER (score>={{t}}) OVER (PARTITION BY stack_id) AS np,MAX(score) OVER (PARTITION BY stack_id) AS pk FROM sc),
kept AS (SELECT stack_id,frame_idx,score,(pk=0 OR score>={{t}} OR (np<2 AND rn<=2)) AS kept FROM rk)"""

WARP = ("a00", "a01", "tx", "a10", "a11", "ty")


def r(columns, digits: int = 6) -> str:
    return ",".join(f"ROUND({c},{digits})+0.0 AS {c}" for c in columns)


def chain_sql(least: float, flat: bool, digits: int) -> str:
    """Composed outwards from frame 2, one step of a recursion each; flat: the sum keeps its shift only, its steps are
    freed of rotation (their symmetric part stays)."""
    # a step without rotation: V S V' of M = sqrt(M'M)
    tr = "SQRT(m00+m11+2*SQRT(GREATEST(m00*m11-m01*m01,0)))"
    root = "SQRT(GREATEST(m00*m11-m01*m01,0))"
    mm = "SELECT *,a00*a00+a10*a10 AS m00,a00*a01+a10*a11 AS m01,a01*a01+a11*a11 AS m11 FROM st"
    step = f"SELECT stack_id,frame_idx,(m00+{root})/{tr} AS a00,m01/{tr} AS a01,tx,m01/{tr} AS a10,(m11+{root})/{tr} AS a11,ty FROM ({mm})" if flat else "SELECT * FROM st"
    lin = ("1.0", "0.0", "0.0", "1.0") if flat else ("c.a00*s.a00+c.a01*s.a10", "c.a00*s.a01+c.a01*s.a11", "c.a10*s.a00+c.a11*s.a10", "c.a10*s.a01+c.a11*s.a11")
    new = (lin[0], lin[1], "c.a00*s.tx+c.a01*s.ty+c.tx", lin[2], lin[3], "c.a10*s.tx+c.a11*s.ty+c.ty")
    case = lambda e, old: f"CASE WHEN s.frame_idx%4<>3 THEN {e} ELSE c.{old} END AS {old}"
    quiet = f"conv AND SQRT(tx*tx+ty*ty)<{least} AND ABS(a00-1)<=1.01e-3 AND ABS(a11-1)<=1.01e-3 AND ABS(a01)<=1e-3 AND ABS(a10)<=1e-3"
    own = ",".join(f"ROUND(CASE WHEN {quiet} THEN {v} ELSE {c} END,{digits})+0.0 AS {c}" for c, v in zip(WARP, ("1.0", "0.0", "0.0", "0.0", "1.0", "0.0"), strict=True))
    return f"""WITH RECURSIVE {STEPS}, sp AS ({step}), c AS (
 SELECT DISTINCT stack_id,2 AS frame_idx,d.d AS dir,CAST(1 AS DOUBLE) AS a00,CAST(0 AS DOUBLE) AS a01,CAST(0 AS DOUBLE) AS tx,CAST(0 AS DOUBLE) AS a10,CAST(1 AS DOUBLE) AS a11,CAST(0 AS DOUBLE) AS ty,false AS conv FROM st CROSS JOIN (VALUES (1),(-1)) d(d)
 UNION ALL SELECT c.stack_id,s.frame_idx,c.dir,{','.join(case(e, o) for e, o in zip(new, WARP, strict=True))},s.frame_idx%4<>3 AS conv FROM c JOIN sp s ON s.stack_id=c.stack_id AND s.frame_idx=c.frame_idx+c.dir)
SELECT stack_id,frame_idx,{own} FROM c WHERE NOT (frame_idx=2 AND dir=-1)"""


ODD = f"{STEPS}, o AS (SELECT stack_id,frame_idx,a00+0.01*frame_idx AS a00,a01*512+0.125 AS a01,tx,a10,a11+0.25 AS a11,ty FROM st)"
# the rotation of the polar decomposition by angle t; the symmetric factor P = R' M; eigenvalues of P are the scales
POLAR = """q AS (SELECT *,SQRT((a00+a11)*(a00+a11)+(a10-a01)*(a10-a01)) AS z FROM o),
pol AS (SELECT *,(a00+a11)/z AS c,(a10-a01)/z AS s FROM q),
sym AS (SELECT *,c*a00+s*a10 AS p00,c*a01+s*a11 AS p01,c*a11-s*a01 AS p11 FROM pol),
sv AS (SELECT *,(p00+p11)/2+SQRT((p00-p11)*(p00-p11)/4+p01*p01) AS s0,(p00+p11)/2-SQRT((p00-p11)*(p00-p11)/4+p01*p01) AS s1 FROM sym)"""


def canvas_sql(crop: bool) -> str:
    pick = (lambda a, o, i: f"CASE WHEN ix1>ix0 AND iy1>iy0 THEN {i} ELSE {o} END") if crop else (lambda a, o, i: o)
    x0, x1, y0, y1 = (pick(c, "o" + c, "i" + c) for c in ("x0", "x1", "y0", "y1"))
    return f"""WITH {STEPS}, k AS (SELECT stack_id,frame_idx,a00*cx+a01*cy+tx AS px,a10*cx+a11*cy+ty AS py FROM st CROSS JOIN (VALUES (0,0),(48,0),(0,32),(48,32)) c(cx,cy)),
bx AS (SELECT stack_id,frame_idx,MIN(px) AS x0,MAX(px) AS x1,MIN(py) AS y0,MAX(py) AS y1 FROM k GROUP BY ALL),
ev AS (SELECT stack_id,MIN(x0) AS ox0,MAX(x1) AS ox1,MIN(y0) AS oy0,MAX(y1) AS oy1,MAX(x0) AS ix0,MIN(x1) AS ix1,MAX(y0) AS iy0,MIN(y1) AS iy1 FROM bx GROUP BY ALL)
SELECT stack_id,CAST(GREATEST(CEIL(({x1})-({x0})),1) AS INT) AS width,CAST(GREATEST(CEIL(({y1})-({y0})),1) AS INT) AS height,ROUND(0.0-({x0}),6)+0.0 AS off_x,ROUND(0.0-({y0}),6)+0.0 AS off_y FROM ev"""


def warp_sql(fill: bool, cubic: bool = False) -> str:
    """All chains over the whole canvas."""
    inside = "" if fill else " * CASE WHEN fy BETWEEN 0 AND 31 AND fx BETWEEN 0 AND 31 THEN 1 ELSE 0 END"
    near = "CASE WHEN {d}<=1 THEN 1.25::DOUBLE*{d}*{d}*{d}-2.25::DOUBLE*{d}*{d}+1 ELSE -0.75::DOUBLE*{d}*{d}*{d}+3.75::DOUBLE*{d}*{d}-6*{d}+3 END" if cubic else "(1-{d})"
    reach = (-1, 0, 1, 2) if cubic else (0, 1)
    taps = ",".join(f"({dy},{dx})" for dy in reach for dx in reach)
    return f"""WITH {GREY}, {STEPS}, g AS (SELECT st.*,CAST(ys.y AS INT) AS y,CAST(xs.x AS INT) AS x FROM st CROSS JOIN range(32) ys(y) CROSS JOIN range(32) xs(x)),
bk AS (SELECT stack_id,frame_idx,y,x,(a11*(x-tx)-a01*(y-ty))/(a00*a11-a01*a10) AS sx,(a00*(y-ty)-a10*(x-tx))/(a00*a11-a01*a10) AS sy FROM g),
ds AS (SELECT *,ABS(sy-FLOOR(sy)-dy) AS ey,ABS(sx-FLOOR(sx)-dx) AS ex FROM bk CROSS JOIN (VALUES {taps}) d(dy,dx)),
tp AS (SELECT stack_id,frame_idx,y,x,CAST(FLOOR(sy) AS INT)+dy AS fy,CAST(FLOOR(sx) AS INT)+dx AS fx,({near.format(d='ey')})*({near.format(d='ex')}) AS w FROM ds)
SELECT tp.stack_id,tp.frame_idx,tp.y,tp.x,ROUND(SUM(w*f.v{inside}),6)+0.0 AS v FROM tp JOIN f ON f.frame_idx=tp.frame_idx AND f.y={mirror('fy', 32)} AND f.x={mirror('fx', 32)} GROUP BY ALL"""


SLABBED = f"{GREY}, sl AS (SELECT m.i AS slab_idx,f.* FROM f JOIN range(3) m(i) ON f.frame_idx>=2*m.i AND f.frame_idx<2*m.i+3)"
SLAB_FUSED = f"{SLABBED}, {fuse_ctes('sl', 'slab_idx,frame_idx', 'slab_idx', 32, 32, 0, 'fz')}"
LIGHT = "CASE WHEN yy>0.008856 THEN CBRT(yy)*116-16 ELSE yy*903.3 END*2.55"
LIN = lambda c: f"CASE WHEN {c}/255.0<=0.04045 THEN {c}/255.0/12.92 ELSE POW(({c}/255.0+0.055)/1.055,2.4) END"
LIGHTNESS = f"{RGB}, li AS (SELECT frame_idx,y,x,{LIGHT} AS v FROM (SELECT *,0.212671*({LIN('r')})+0.715160*({LIN('g')})+0.072169*({LIN('b')}) AS yy FROM rgb))"
FUSE1 = f"{pyramid_ctes('f', 'frame_idx', 32, 32, 1)}, {weight_ctes('b', 'frame_idx', 32, 32, 1, 4.0, 'w')}, {sum_ctes('b', 'w', '', 'frame_idx', 1, 's')}"
TENENGRAD = f"{GREY}, {UNIT}, {sobel_ctes('u', 'te')}"
NORM = "nm AS (SELECT frame_idx,y,x,e/(MAX(e) OVER (PARTITION BY frame_idx)+1e-8) AS v FROM te)"
RUN = "OVER (PARTITION BY y,x ORDER BY frame_idx)"
FUSE_STACK = f"WITH {GREY}, {fuse_ctes('f', 'frame_idx', '', 32, 32, 1, 'fz')} SELECT y,x,ROUND(v,5)+0.0 AS v FROM fz"

EVEN = f"""{TILES}, pos AS (SELECT *,y/16.0::DOUBLE-0.5 AS gy,x/16.0::DOUBLE-0.5 AS gx FROM f),
tp AS (SELECT frame_idx,y,x,CAST(v AS INT) AS v,LEAST(GREATEST(CAST(FLOOR(gy) AS INT)+dy,0),1) AS ty,LEAST(GREATEST(CAST(FLOOR(gx) AS INT)+dx,0),1) AS tx,(1-ABS(gy-FLOOR(gy)-dy))*(1-ABS(gx-FLOOR(gx)-dx)) AS w FROM pos CROSS JOIN (VALUES (0,0),(0,1),(1,0),(1,1)) d(dy,dx)),
ev AS (SELECT tp.frame_idx,tp.y,tp.x,CAST(FLOOR(SUM(w*lut)+0.5) AS DOUBLE) AS v FROM tp JOIN lut USING (frame_idx,ty,tx,v) GROUP BY ALL)"""
EVEN_TENENGRAD = f"{EVEN}, u AS (SELECT frame_idx,y,x,v/255.0::DOUBLE AS v FROM ev), {sobel_ctes('u', 'te')}"

ORACLE_SQL: dict[str, str] = {
    "frames_ordered": f"WITH {FILES} SELECT CAST(row_number() OVER (ORDER BY path)-1 AS INT) AS frame_idx,path FROM img WHERE {SUPPORTED}",
    "ext_filter": f"WITH {FILES} SELECT ext,COUNT(*) AS n FROM img WHERE {SUPPORTED} GROUP BY 1",
    "gray_luma": f"WITH {RGB} SELECT frame_idx,y,x,CAST(FLOOR(CAST(0.299 AS DOUBLE)*r+CAST(0.587 AS DOUBLE)*g+CAST(0.114 AS DOUBLE)*b+0.5) AS INT) AS v FROM rgb",
    "lab_lightness": f"WITH {LIGHTNESS} SELECT frame_idx,y,x,ROUND(v,6)+0.0 AS v FROM li",
    "depth_shift": f"WITH {GREY} SELECT frame_idx,y,x,CAST(v*257+y*3 AS INT)>>8 AS shifted,CAST(FLOOR((v*257+y*3)/257) AS INT) AS scaled FROM f",
    "clip_cast": f"WITH {GREY} SELECT frame_idx,y,x,CAST(FLOOR(LEAST(GREATEST(v*1.75-60.5,0.0),255.0)) AS INT) AS v FROM f",
    "confidence_alpha": f"WITH {GREY} SELECT frame_idx,y,x,ROUND(LEAST(GREATEST((LOG10(v/25000000000000000.0+1e-40)+20)/12,0.0),1.0),6)+0.0 AS alpha FROM f",
    "area_downscale": f"WITH {GREY} SELECT frame_idx,CAST(y//2 AS INT) AS y,CAST(x//2 AS INT) AS x,AVG(v) AS v FROM f GROUP BY ALL",
    "area_resize": f"""WITH {GREY}, ty AS (SELECT CAST(i AS INT) AS i FROM range(13) t(i)), tx AS (SELECT CAST(i AS INT) AS i FROM range(20) t(i))
SELECT frame_idx,ty.i AS y,tx.i AS x,ROUND(SUM(v*(LEAST(f.y+1,(ty.i+1)*32/13.0::DOUBLE)-GREATEST(f.y,ty.i*32/13.0::DOUBLE))*13/32.0::DOUBLE*(LEAST(f.x+1,(tx.i+1)*1.6::DOUBLE)-GREATEST(f.x,tx.i*1.6::DOUBLE))/1.6::DOUBLE),8)+0.0 AS v
FROM f JOIN ty ON f.y+1>ty.i*32/13.0::DOUBLE AND f.y<(ty.i+1)*32/13.0::DOUBLE JOIN tx ON f.x+1>tx.i*1.6::DOUBLE AND f.x<(tx.i+1)*1.6::DOUBLE GROUP BY ALL""",
    "pyr_reduce": f"WITH {GREY} SELECT * FROM {reduce_sql('f', 'frame_idx', 32, 32)}",
    "pyr_expand": f"WITH {GREY} SELECT * FROM {expand_sql('f', 'frame_idx', 32, 32, 63, 64)}",
    "pyr_laplacian": f"WITH {GREY}, {pyramid_ctes('f', 'frame_idx', 32, 32, 2)} {union_levels('b', 2, 'frame_idx,y,x,v')}",
    "pyr_collapse": f"WITH {GREY}, {pyramid_ctes('f', 'frame_idx', 32, 32, 2)}, {collapse_ctes('b', 'frame_idx', 32, 32, 2, 'img')} SELECT frame_idx,y,x,v FROM img",
    "region_energy": f"WITH {GREY} SELECT frame_idx,y,x,{r(['e'])} FROM {energy_sql('f', 'frame_idx', 32, 32)}",
    "region_deviation": f"WITH {GREY} SELECT frame_idx,y,x,{r(['d'])} FROM {deviation_sql('f', 'frame_idx', 32, 32)}",
    "region_entropy": f"WITH {GREY} SELECT frame_idx,y,x,{r(['h'])} FROM {entropy_sql('f', 'frame_idx', 32, 32)}",
    "gauss_blur": f"WITH {GREY} SELECT frame_idx,y,x,{r(['v'])} FROM {blur_sql('f', 'frame_idx', 32, 15)}",
    "sobel_energy": f"WITH {GREY}, {sobel_ctes('f', 'so')} SELECT frame_idx,y,x,e FROM so",
    "laplacian3": f"WITH {GREY} SELECT frame_idx,y,x,v FROM {LAPLACE}",
    "dilate7": f"WITH {GREY} SELECT frame_idx,y,x,v FROM {dilate_sql('f')}",
    "clahe_tile_hist": f"WITH {TILES} SELECT frame_idx,ty,tx,v,n FROM hist",
    "clahe_lut": f"WITH {TILES} SELECT frame_idx,ty,tx,v,lut FROM lut",
    "clahe_equalise": f"WITH {EVEN} SELECT frame_idx,y,x,v FROM ev",
    "focus_mask_p30": f"WITH {GREY}, {MASK} SELECT frame_idx,y,x,mask FROM mask",
    "mask_population": f"WITH {GREY}, {MASK} SELECT frame_idx,CAST(SUM(mask) AS BIGINT) AS n FROM mask GROUP BY 1",
    "mask_intersection": f"""WITH {GREY}, a AS (SELECT frame_idx,y,x,CASE WHEN v>=140 THEN 1 ELSE 0 END AS m FROM f), b AS (SELECT frame_idx+1 AS frame_idx,y,x,CASE WHEN v>=20*frame_idx+60 THEN 1 ELSE 0 END AS k FROM f),
j AS (SELECT a.*,k FROM a JOIN b USING (frame_idx,y,x)), n AS (SELECT frame_idx,SUM(m&k) AS na,SUM(m|k) AS no FROM j GROUP BY 1)
SELECT j.frame_idx,y,x,CASE WHEN na>=350 THEN m&k WHEN no>=350 THEN m|k ELSE 1 END AS mask FROM j JOIN n ON j.frame_idx=n.frame_idx""",
    "tenengrad_score": f"WITH {TENENGRAD} SELECT frame_idx,y,x,{r(['e'])} FROM te",
    "tenengrad_equalised": f"WITH {EVEN_TENENGRAD} SELECT frame_idx,y,x,{r(['e'])} FROM te",
    "hf_lf_ratio": f"""WITH {TENENGRAD}, {NORM}, bl AS {blur_sql('nm', 'frame_idx', 32, 31)},
m AS (SELECT frame_idx,AVG((nm.v-bl.v)*(nm.v-bl.v)) AS hf,AVG(bl.v*bl.v) AS lf FROM nm JOIN bl USING (frame_idx,y,x) WHERE nm.v>0.01 GROUP BY 1)
SELECT g.frame_idx,ROUND(COALESCE(CASE WHEN lf>0 THEN hf/lf END,0.0),6)+0.0 AS score FROM (SELECT DISTINCT frame_idx FROM nm) g LEFT JOIN m ON g.frame_idx=m.frame_idx""",
    "cull_threshold": f"WITH {SCORES.format(t=2.6)} SELECT stack_id,frame_idx,score,kept FROM kept",
    "cull_top2_floor": f"WITH {SCORES.format(t=1000.0)} SELECT stack_id,frame_idx,score,kept FROM kept",
    "cull_kept_frames": f"WITH {SCORES.format(t=2.6)} SELECT s.stack_id,s.frame_idx,SUM(v) AS v FROM s JOIN kept k ON s.stack_id=k.stack_id AND s.frame_idx=k.frame_idx WHERE kept GROUP BY ALL",
    "focus_weights": f"WITH {GREY}, {pyramid_ctes('f', 'frame_idx', 32, 32, 1)}, {weight_ctes('b', 'frame_idx', 32, 32, 1, 1.0, 'w')} SELECT level,frame_idx,y,x,ROUND(e,6)+0.0 AS v FROM ({union_levels('w', 1, 'frame_idx,y,x,e')})",
    "fuse_partial": f"WITH {GREY}, {FUSE1} SELECT level,y,x,ROUND(sex/(se+1e-40),5)+0.0 AS mean,ROUND(sx,5)+0.0 AS sx,n,ROUND(LOG10(se+1e-40),5)+0.0 AS log_se FROM ({union_levels('s', 1, 'y,x,se,sex,sx,n')})",
    "fuse_final": f"WITH {GREY}, {FUSE1}, {final_ctes('s', '', 1, 'v')} SELECT level,y,x,{r(['v'], 5)} FROM ({union_levels('v', 1, 'y,x,v')})",
    "fuse_stack": FUSE_STACK,
    "block_fuse": FUSE_STACK,
    "fuse_stacks": f"WITH {STACKS}, {fuse_ctes('s', 'stack_id,frame_idx', 'stack_id', 8, 8, 0, 'fz')} SELECT stack_id,y,x,{r(['v'], 5)} FROM fz",
    "fuse_rgb": f"""WITH {LIGHTNESS}, me AS (SELECT frame_idx,0 AS c,y,x,CAST(r AS DOUBLE) AS v FROM rgb UNION ALL SELECT frame_idx,1,y,x,CAST(g AS DOUBLE) FROM rgb UNION ALL SELECT frame_idx,2,y,x,CAST(b AS DOUBLE) FROM rgb),
{fuse_ctes('me', 'frame_idx,c', 'c', 32, 32, 1, 'fz', 'li', 'frame_idx')} SELECT c,y,x,{r(['v'], 4)} FROM fz""",
    "neighbour_pairs": f"WITH {STEPS} SELECT stack_id,frame_idx,CASE WHEN frame_idx>2 THEN frame_idx-1 ELSE frame_idx+1 END AS neighbour_idx FROM st WHERE frame_idx<>2",
    "global_pairs": f"WITH {STEPS} SELECT stack_id,frame_idx,2 AS neighbour_idx FROM st WHERE frame_idx<>2",
    "affine_chain": chain_sql(1.5, False, 9),
    "affine_translate_chain": chain_sql(0.0, True, 6),
    "warp_no_shear": f"WITH {ODD}, {POLAR} SELECT stack_id,frame_idx,{r(WARP, 8)} FROM (SELECT stack_id,frame_idx,c*s0 AS a00,0.0-s*s1 AS a01,tx,s*s0 AS a10,c*s1 AS a11,ty FROM sv)",
    "warp_no_scale": f"WITH {ODD} SELECT stack_id,frame_idx,{r(WARP, 8)} FROM (SELECT stack_id,frame_idx,a00/d AS a00,a01/d AS a01,tx,a10/d AS a10,a11/d AS a11,ty FROM (SELECT *,SQRT(ABS(a00*a11-a01*a10)) AS d FROM o))",
    "warp_no_rotation": f"WITH {ODD}, {POLAR} SELECT stack_id,frame_idx,{r(WARP, 8)} FROM (SELECT stack_id,frame_idx,p00 AS a00,p01 AS a01,tx,p01 AS a10,p11 AS a11,ty FROM sv)",
    "warp_constrain_all": f"WITH {ODD}, {POLAR} SELECT stack_id,frame_idx,{r(WARP, 8)} FROM (SELECT stack_id,frame_idx,SQRT(s0/s1) AS a00,0.0 AS a01,0.0 AS tx,0.0 AS a10,SQRT(s1/s0) AS a11,0.0 AS ty FROM sv)",
    "warp_validate": f"WITH {ODD} SELECT stack_id,frame_idx,(SQRT((tx-0.5)*(tx-0.5)+(ty+0.5)*(ty+0.5))<=0.15*16 AND SQRT((a00-1)*(a00-1)+a01*a01+a10*a10+(a11-1)*(a11-1))<=0.3) AS plausible FROM o",
    "warp_negligible": f"WITH {STEPS} SELECT stack_id,frame_idx,(SQRT(tx*tx+ty*ty)<2.5 AND ABS(a00-1)<=1.01e-3 AND ABS(a11-1)<=1.01e-3 AND ABS(a01)<=1e-3 AND ABS(a10)<=1e-3) AS negligible,(ABS(a00-1)<=1.1e-4 AND ABS(a11-1)<=1.1e-4 AND ABS(a01)<=1e-4 AND ABS(a10)<=1e-4) AS pure_translation FROM st",
    "warp_message": f"WITH {STEPS} SELECT stack_id,frame_idx,printf('frame %d: rotation %+.2f°  shift (%+.1f, %+.1f) px',frame_idx,DEGREES(ATAN2(a10,a00)),ty,tx) AS message FROM st",
    "canvas_expand": canvas_sql(False),
    "canvas_crop": canvas_sql(True),
    "warp_bilinear": warp_sql(True),
    "warp_bicubic": warp_sql(True, True),
    "warp_no_fill": warp_sql(False),
    "slab_ranges": f"""WITH RECURSIVE {STACKS}, n AS (SELECT stack_id,COUNT(DISTINCT frame_idx) AS n FROM s GROUP BY 1),
w AS (SELECT stack_id,n,0 AS i,0 AS a,LEAST(10,n) AS b FROM n UNION ALL SELECT stack_id,n,i+1,a+7,LEAST(a+17,n) FROM w WHERE b<n)
SELECT stack_id,1 AS layer,i AS slab_idx,a AS start_idx,CAST(b AS INT) AS end_idx,printf('slab_1_%03d',i+1) AS label FROM w""",
    "slab_fuse": f"WITH {SLAB_FUSED} SELECT CAST(slab_idx AS INT) AS slab_idx,y,x,{r(['v'], 5)} FROM fz",
    "slab_recursive": f"""WITH {SLAB_FUSED}, again AS (SELECT slab_idx AS frame_idx,y,x,FLOOR(LEAST(GREATEST(ROUND(v,5),0.0),255.0)) AS v FROM fz),
{fuse_ctes('again', 'frame_idx', '', 32, 32, 0, 'gz')} SELECT y,x,{r(['v'], 5)} FROM gz""",
    "preview_running": f"""WITH {GREY}, j AS (SELECT f.*,e FROM f JOIN {energy_sql('f', 'frame_idx', 32, 32)} g USING (frame_idx,y,x))
SELECT frame_idx,y,x,ROUND(SUM(e) {RUN},3)+0.0 AS se,ROUND(SUM(e*v) {RUN},3)+0.0 AS sex,ROUND(SUM(v) {RUN},3)+0.0 AS sx,COUNT(*) {RUN} AS n FROM j""",
    "stream_state_sum": "SELECT event_type AS stack_id,CAST(EXTRACT(DAY FROM ts) AS INT)-1 AS frame_idx,CAST(user_id%8 AS INT) AS y,CAST(EXTRACT(HOUR FROM ts) AS INT) AS x,COUNT(*) AS v FROM events GROUP BY 1,2,3,4",
    "stream_frames": f"""WITH {STACKS}, {fuse_ctes('s', 'stack_id,frame_idx', 'stack_id', 8, 8, 0, 'fz')}, a AS (SELECT stack_id,COUNT(DISTINCT frame_idx) AS n FROM s GROUP BY 1)
SELECT stack_id,n,ROUND(AVG(ROUND(v,9)),4)+0.0 AS mean FROM fz JOIN a USING (stack_id) GROUP BY 1,2""",
    "stream_fuse": f"WITH {STACKS}, {fuse_ctes('s', 'stack_id,frame_idx', 'stack_id', 8, 8, 0, 'fz')} SELECT stack_id,y,x,{r(['v'], 5)} FROM fz",
    # what was put in must be found
    "phase_shift": """SELECT CAST(n_nationkey AS INT) AS "case", CAST(n_nationkey%7-3 AS INT) AS dx, CAST(n_nationkey*3%11-5 AS INT) AS dy,
 CAST(n_nationkey%7-3 AS INT) AS found_x, CAST(n_nationkey*3%11-5 AS INT) AS found_y FROM nation""",
    "ecc_affine": f"WITH {STEPS} SELECT stack_id, frame_idx, true AS found FROM st",
}
