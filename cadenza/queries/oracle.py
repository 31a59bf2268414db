"""The registered queries once more as plain SQL over the test tables, for comparison."""

from __future__ import annotations

from cadenza.operators.moderation import (
    ACCEPTED_MESSAGE,
    BLOCKED_MESSAGE,
    REPORT_STATUS,
    REPORT_TEXT,
    STAND_IN_WORDS,
)
from cadenza.queries.jobs import MEDIA, ONE_USER, SIMILAR

EDGES = """
line AS (SELECT o_custkey AS user_id, l_partkey, l_suppkey, l_returnflag AS f, l_linestatus AS s
         FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
likes AS (SELECT user_id, l_partkey AS item_id FROM line WHERE f = 'R'),
plays AS (SELECT user_id, l_partkey AS item_id FROM line WHERE f <> 'R'),
follows AS (SELECT user_id, l_suppkey AS item_id FROM line WHERE f = 'R' AND s = 'F')"""

RATINGS = {
    "likes": "r AS (SELECT DISTINCT user_id, item_id, CAST(1 AS BIGINT) AS w FROM likes)",
    "plays": "r AS (SELECT user_id, item_id, count(*) AS w FROM plays GROUP BY 1, 2)",
    "combined": """r AS (SELECT user_id, item_id, CAST(sum(w) AS BIGINT) AS w FROM
      (SELECT user_id, item_id, 10 AS w FROM likes UNION ALL SELECT user_id, item_id, 1 FROM plays) GROUP BY 1, 2)""",
    "follow": "r AS (SELECT DISTINCT user_id, item_id, CAST(1 AS BIGINT) AS w FROM follows)",
}

USERS = {
    "all": "u AS (SELECT c_custkey AS user_id FROM customer)",
    "raters": "u AS (SELECT DISTINCT user_id FROM r)",
}

SIMILARITY = """
norms AS (SELECT user_id, CAST(sum(w * w) AS BIGINT) AS n FROM r GROUP BY 1),
dots AS (SELECT a.user_id, b.user_id AS other_id, sum(a.w * b.w) AS dot
         FROM r a JOIN r b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1, 2),
sim AS (SELECT d.user_id, d.other_id, CAST(dot AS DOUBLE) / sqrt(CAST(x.n AS DOUBLE) * CAST(y.n AS DOUBLE)) AS cos
        FROM dots d JOIN norms x ON x.user_id = d.user_id JOIN norms y ON y.user_id = d.other_id)"""


def _neighbors(k: int = 5) -> str:
    return f"""
low AS (SELECT user_id AS other_id FROM u ORDER BY 1 LIMIT {k + 1}),
pool AS (SELECT user_id, other_id, cos FROM sim UNION ALL
         SELECT u.user_id, low.other_id, 0.0 FROM u, low WHERE u.user_id <> low.other_id AND NOT EXISTS
           (SELECT 1 FROM sim s WHERE s.user_id = u.user_id AND s.other_id = low.other_id)),
near AS (SELECT user_id, rank, other_id, cos FROM
         (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY cos DESC, other_id) AS INTEGER) AS rank FROM pool)
         WHERE rank <= {k})"""


# Every item is a candidate: those no neighbour touched have weight 0. They can be on the first
# two pages only of users with fewer than 20 others.
RECOMMENDED = """
scored AS (SELECT n.user_id, r.item_id, CAST(sum(r.w) AS BIGINT) AS w
           FROM near n JOIN r ON r.user_id = n.other_id GROUP BY 1, 2),
unseen AS (SELECT user_id, item_id, w FROM scored s
           WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = s.user_id AND r.item_id = s.item_id)),
lacking AS (SELECT u.user_id FROM u LEFT JOIN unseen USING (user_id) GROUP BY 1 HAVING count(item_id) < 20),
tail AS (SELECT l.user_id, i.item_id, CAST(0 AS BIGINT) AS w FROM lacking l, i
         WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.user_id = l.user_id AND s.item_id = i.item_id)
           AND NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND r.item_id = i.item_id)),
rec AS (SELECT user_id, item_id, w, CAST(row_number() OVER (PARTITION BY user_id ORDER BY w DESC, item_id) AS INTEGER) AS rank
        FROM (SELECT * FROM unseen UNION ALL SELECT * FROM tail))"""

ITEMS = {
    "likes": "i AS (SELECT DISTINCT item_id FROM r)",
    "plays": "i AS (SELECT DISTINCT item_id FROM r)",
    "combined": "i AS (SELECT p_partkey AS item_id FROM part)",
    "follow": "i AS (SELECT s_suppkey AS item_id FROM supplier)",
}


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def _near(kind: str, users: str, k: int = 5) -> str:
    return _with(EDGES, RATINGS[kind], USERS[users], SIMILARITY, _neighbors(k))


def _rec(kind: str, users: str) -> str:
    return _near(kind, users) + ",\n" + ITEMS[kind] + "," + RECOMMENDED


def _page(kind: str, users: str, first: int, last: int, scale: str) -> str:
    return _rec(kind, users) + f"\nSELECT user_id, rank, item_id, w / {scale} AS score FROM rec WHERE rank BETWEEN {first} AND {last}"


def _lists(name: str, kind: str) -> str:
    """One side of the report, as a subquery with its own ratings."""
    inner = _with(RATINGS[kind], USERS["raters"], SIMILARITY, _neighbors(), ITEMS[kind]) + "," + RECOMMENDED
    return f"""{name} AS ({inner}
      SELECT u.user_id,
        (SELECT string_agg(other_id, '|' ORDER BY rank) FROM near WHERE near.user_id = u.user_id) AS users,
        (SELECT string_agg(item_id, '|' ORDER BY rank) FROM rec WHERE rec.user_id = u.user_id AND rank <= 5) AS items
      FROM u)"""


WORDS = "[" + ", ".join(f"'{w}'" for w in STAND_IN_WORDS) + "]"

COMMENTS = f"""
request AS (SELECT d.doc_id AS id, CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id - 7 END AS parent,
              e.user_id, CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) AS song_id, d.text AS content, e.ts
            FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id),
hit AS (SELECT *, len(list_intersect(list_distinct(string_split_regex(lower(content), '[^a-z]+')), {WORDS})) AS h FROM request),
scored AS (SELECT *, 1.0 - pow(CAST(4 AS DOUBLE), -h) AS toxic, 1.0 - pow(CAST(4 AS DOUBLE), -h) > 0.9 AS blocked,
             strftime(ts + INTERVAL 7 HOUR, '%m/%d/%Y %H:%M:%S') AS shown FROM hit),
stored AS (SELECT id, CASE WHEN NOT blocked OR parent IN (SELECT doc_id FROM labels)
               OR EXISTS (SELECT 1 FROM request p WHERE p.id = scored.parent AND (p.ts < scored.ts OR p.ts = scored.ts AND p.id < scored.id))
             THEN parent END AS parent,
             user_id, song_id, content, blocked, shown FROM scored)"""

STORED = (
    "WITH " + COMMENTS + """
SELECT id, CAST(parent AS VARCHAR) AS "commentParentId", CAST(user_id AS VARCHAR) AS "userId",
  CAST(song_id AS VARCHAR) AS "songId", content, blocked AS hide, shown AS "createdAt", shown AS "updatedAt" FROM stored"""
)

SCORES = "WITH " + COMMENTS + """
SELECT id, toxic AS score_1, CAST(0 AS DOUBLE) AS score_2, CAST(0 AS DOUBLE) AS score_3,
  CAST(0 AS DOUBLE) AS score_4, CAST(0 AS DOUBLE) AS score_5, CAST(0 AS DOUBLE) AS score_6, blocked FROM scored"""

SONG = f"""
song AS (SELECT p_partkey AS id, p_name AS title, CAST(p_size AS INTEGER) AS duration, p_brand, p_type = 'SMALL' AS privacy,
           CASE WHEN p_partkey % 2 = 0 THEN 'audio/{MEDIA.marker}/' || p_brand || '/' || p_partkey || '.mp3'
                ELSE 'https://cdn.example.org/' || p_partkey || '.mp3' END AS path,
           CASE WHEN p_partkey % 2 = 0 THEN '"' || p_brand || '/' || p_partkey || '.mp3"'
                ELSE 'https://cdn.example.org/' || p_partkey || '.mp3' END AS opened,
           CASE WHEN p_size > 5 THEN strftime(DATE '2020-01-01' + CAST(p_size AS INTEGER), '%m/%d/%Y 07:00:00') END AS released,
           strftime(TIMESTAMP '2024-01-01 07:00:00' + to_seconds(p_partkey), '%m/%d/%Y %H:%M:%S') AS created
         FROM part)"""

URL = f"https://{MEDIA.bucket}.{MEDIA.endpoint}/"

CARDS = f"""
image AS (SELECT DISTINCT p_brand, p_type, CASE WHEN p_type = 'SMALL' THEN p_brand || '/' || p_type || '.jpg'
            ELSE '{URL}{MEDIA.marker}/' || p_brand || '/' || p_type || '.jpg' END || ':' || length(p_type) AS x FROM part),
album AS (SELECT p_brand, p_brand || ':' || p_brand || ':album:' || string_agg(x, ',' ORDER BY x) AS x FROM image GROUP BY 1),
genre AS (SELECT s_suppkey, 'n' || n_nationkey || '=' || n_name AS g FROM supplier JOIN nation ON n_nationkey = s_nationkey
          UNION ALL SELECT s_suppkey, 'r' || r_regionkey || '=' || r_name FROM supplier
          JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
genres AS (SELECT s_suppkey, string_agg(g, '|' ORDER BY g) AS bars, string_agg(g, ',' ORDER BY g) AS commas FROM genre GROUP BY 1),
bridge AS (SELECT l_partkey, l_suppkey, max(l_linenumber = 1) AS main FROM lineitem GROUP BY 1, 2),
artist AS (SELECT l_partkey, l_suppkey || ':' || s_name || ':' || main || ':' || commas AS x
           FROM bridge JOIN supplier ON s_suppkey = l_suppkey JOIN genres USING (s_suppkey)),
artists AS (SELECT l_partkey, string_agg(x, '|' ORDER BY x) AS xs, count(*) AS c FROM artist GROUP BY 1),
acard AS (SELECT CAST(s.s_suppkey AS VARCHAR) AS id, s_name AS name, CASE WHEN s.s_suppkey % 2 = 0
            THEN '{URL}{MEDIA.marker}/artist/' || s.s_suppkey || '.jpg' ELSE 'artist/' || s.s_suppkey || '.jpg' END AS avatar,
            bars AS genres, s.s_suppkey FROM supplier s JOIN genres USING (s_suppkey))"""

USER = f"""
person AS (SELECT c_custkey AS id, c_name AS username, lower(replace(c_name, '#', '.')) || '@example.org' AS email,
             CASE WHEN c_custkey % 100 = 0 THEN 'Admin' ELSE 'User' END AS role,
             CASE WHEN c_acctbal < 0 THEN NULL WHEN c_custkey % 2 = 0 THEN '{URL}{MEDIA.marker}/avatar/' || c_custkey || '.png'
                  ELSE 'https://img.example.org/' || c_custkey || '.png' END AS url FROM customer)"""


def _fk(relation: str, child: str, column: str, parent: str, key: str) -> str:
    return f"""SELECT '{relation}' AS relation, count({column}) AS refs,
  CAST(count(*) FILTER (WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent})) AS BIGINT) AS orphans FROM {child}"""


FKS = "\nUNION ALL ".join(
    _fk(*x)
    for x in [
        ("Comment.userId", "request", "user_id", "customer", "c_custkey"),
        ("Comment.songId", "request", "song_id", "part", "p_partkey"),
        ("Song.uploadUserId", "(SELECT CAST(NULL AS BIGINT) AS x FROM part)", "x", "customer", "c_custkey"),
        ("Like.userId", "likes", "user_id", "customer", "c_custkey"),
        ("Like.songId", "likes", "item_id", "part", "p_partkey"),
        ("SongPlayHistory.userId", "plays", "user_id", "customer", "c_custkey"),
        ("SongPlayHistory.songId", "plays", "item_id", "part", "p_partkey"),
        ("Follow.userId", "follows", "user_id", "customer", "c_custkey"),
        ("Follow.artistId", "follows", "item_id", "supplier", "s_suppkey"),
        ("ArtistSong.songId", "bridge", "l_partkey", "part", "p_partkey"),
        ("ArtistSong.artistId", "bridge", "l_suppkey", "supplier", "s_suppkey"),
        ("ArtistGenre.artistId", "genre", "s_suppkey", "supplier", "s_suppkey"),
        ("ArtistGenre.genreId", "(SELECT split_part(g, '=', 1) AS g FROM genre)", "g",
         "(SELECT 'n' || n_nationkey AS g FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region)", "g"),
        ("AlbumSong.songId", "part", "p_partkey", "part", "p_partkey"),
        ("AlbumSong.albumId", "part", "p_brand", "album", "p_brand"),
        ("AlbumImage.albumId", "image", "p_brand", "album", "p_brand"),
        ("Report.userId", "(SELECT CAST(NULL AS BIGINT) AS x FROM scored WHERE blocked)", "x", "customer", "c_custkey"),
        ("Report.commentId", "(SELECT id FROM scored WHERE blocked)", "id", "request", "id"),
    ]
)


def _defects(kind: str, edges: str, items: str, key: str) -> str:
    return f"""SELECT '{kind}' AS kind, count(*) AS edges,
  CAST(count(*) FILTER (WHERE user_id NOT IN (SELECT c_custkey FROM customer)) AS BIGINT) AS unknown_user,
  CAST(count(*) FILTER (WHERE item_id NOT IN (SELECT {key} FROM {items})) AS BIGINT) AS unknown_item FROM {edges}"""


EVENT_AS_SONG = "(SELECT user_id, event_id AS item_id FROM events)"
EVENT_AS_USER = "(SELECT event_id AS user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id FROM events)"

KNOWN_RATINGS = f"""r AS (SELECT user_id, item_id, CAST(sum(w) AS BIGINT) AS w FROM
  (SELECT user_id, item_id, 10 AS w FROM likes UNION ALL SELECT user_id, item_id, 1 FROM plays
   UNION ALL SELECT user_id, item_id, 10 FROM {EVENT_AS_USER} UNION ALL SELECT user_id, item_id, 1 FROM {EVENT_AS_SONG})
  WHERE user_id IN (SELECT c_custkey FROM customer) AND item_id IN (SELECT p_partkey FROM part) GROUP BY 1, 2)"""

EVENT_RATINGS = """r AS (SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id,
    CAST(sum(CASE event_type WHEN 'purchase' THEN 10 ELSE 1 END) AS BIGINT) AS w
  FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2)"""

# the test tables have these albums
ALBUMS = [f"Brand#{i}" for i in range(1, 26)]

WIDE = (
    f"WITH {EDGES}, {RATINGS['combined']} SELECT c_custkey AS user_id, "
    + ", ".join(f"CAST(coalesce(sum(w) FILTER (WHERE p_brand = '{a}'), 0) AS BIGINT) AS {a.replace('Brand#', 'album_')}" for a in ALBUMS)
    + " FROM customer LEFT JOIN r ON user_id = c_custkey LEFT JOIN part ON p_partkey = item_id GROUP BY 1"
)

SALT = f"unhex(substr(sha256('{MEDIA.nonce}:' || id), 1, 16))"
SECRET = f"CAST('{MEDIA.password}' AS BLOB) || {SALT}"

ORACLE: dict[str, str] = {
    "user_listing": f"WITH {USER} SELECT id, username, email FROM person",
    "song_listing": "SELECT p_partkey AS id, p_name AS title FROM part",
    "comment_listing": f'SELECT id, "commentParentId", CAST("userId" AS BIGINT) AS "userId", '
    f'CAST("songId" AS BIGINT) AS "songId", content, hide FROM ({STORED})',
    "point_lookup": """SELECT a.id, c_name AS username FROM
      (SELECT doc_id AS id FROM documents UNION SELECT event_id FROM events) a LEFT JOIN customer ON c_custkey = a.id""",
    "song_filter_order": f"WITH {SONG} SELECT id, title, duration FROM song WHERE privacy AND duration = 10 ORDER BY title",
    "song_group_counts": f"""WITH {SONG} SELECT title, count(*) AS songs, min(duration) AS shortest, max(duration) AS longest
      FROM song WHERE NOT privacy GROUP BY title""",
    "like_edges": f'WITH {EDGES} SELECT user_id, item_id AS song_id, 1 AS "like" FROM likes',
    "play_counts": f"""WITH {EDGES} SELECT user_id, item_id AS song_id, count(item_id) AS listen_count
      FROM plays LEFT JOIN part ON p_partkey = item_id GROUP BY 1, 2""",
    "follow_edges": f"WITH {EDGES} SELECT DISTINCT user_id, item_id AS artist_id, CAST(1 AS BIGINT) AS w FROM follows",
    "combined_ratings": f"""WITH {EDGES}, {RATINGS["combined"]} SELECT user_id, item_id, w, w / 10.0 AS score FROM r
      JOIN customer ON c_custkey = user_id JOIN part ON p_partkey = item_id""",
    "orphan_interactions": f"WITH {EDGES} {_defects('like', 'likes', 'part', 'p_partkey')} UNION ALL "
    f"{_defects('play', 'plays', 'part', 'p_partkey')} UNION ALL {_defects('follow', 'follows', 'supplier', 's_suppkey')} UNION ALL "
    f"{_defects('event', EVENT_AS_SONG, 'part', 'p_partkey')} UNION ALL {_defects('buyer', EVENT_AS_USER, 'part', 'p_partkey')}",
    "duplicate_edges": f"WITH {EDGES} SELECT user_id, item_id, count(*) AS n FROM likes GROUP BY 1, 2 HAVING count(*) > 1",
    "fk_integrity": f"WITH {EDGES}, {CARDS}, {COMMENTS} {FKS}",
    "unknown_users": f"WITH {EDGES} SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM likes)",
    "rating_matrix_wide": WIDE,
    "export_rating_matrix": WIDE,
    "export_play_counts": f"WITH {EDGES} SELECT user_id, item_id AS song_id, count(*) AS listen_count FROM plays GROUP BY 1, 2",
    "export_song_records": """SELECT p_partkey AS id, p_name AS title, CAST(p_size AS INTEGER) AS duration, p_type = 'SMALL' AS privacy,
        CAST(NULL AS VARCHAR) AS lyric,
        CASE WHEN p_size > 5 THEN strftime(DATE '2020-01-01' + CAST(p_size AS INTEGER), '%Y-%m-%d') END AS "releaseDate" FROM part""",
    "recommend_songs_given_users": _page("combined", "all", 1, 10, "10.0") + " AND user_id IN (SELECT user_id FROM events)",
    "similarity_given_users": _with(EDGES, RATINGS["combined"], SIMILARITY)
    + " SELECT user_id, other_id, cos FROM sim WHERE user_id IN (SELECT e.user_id FROM events e JOIN customer ON c_custkey = e.user_id)",
    **{
        f"similar_users_{kind}": _with(EDGES, RATINGS[kind], SIMILARITY) + f" SELECT user_id, other_id, cos FROM sim WHERE cos >= {SIMILAR}"
        for kind in ("likes", "combined", "follow")
    },
    "export_similarity": _with(EDGES, RATINGS["likes"], SIMILARITY) + " SELECT user_id, other_id, cos FROM sim",
    "export_matrix_blocks": f"""WITH {EDGES}, {RATINGS["combined"]} SELECT user_id, item_id, w FROM r
      JOIN customer ON c_custkey = user_id JOIN part ON p_partkey = item_id""",
    "stream_similarity": "WITH " + EVENT_RATINGS + "," + SIMILARITY + " SELECT user_id, other_id, cos FROM sim",
    "recommend_songs_unknown_ids": _with(EDGES, KNOWN_RATINGS, USERS["all"], SIMILARITY, _neighbors()) + ",\n" + ITEMS["combined"] + ","
    + RECOMMENDED + "\nSELECT user_id, rank, item_id, w / 10.0 AS score FROM rec WHERE rank BETWEEN 1 AND 10",
    "user_norms": f"WITH {EDGES}, {RATINGS['combined']}, {SIMILARITY} SELECT user_id, n FROM norms",
    **{
        f"similarity_{kind}": _with(EDGES, RATINGS[kind], SIMILARITY) + " SELECT user_id, other_id, cos FROM sim"
        for kind in RATINGS
    },
    **{
        f"neighbors_{kind}": _near(kind, "all" if kind in ("combined", "follow") else "raters") + " SELECT * FROM near"
        for kind in RATINGS
    },
    "neighbors_follow_hot": _near("follow", "all") + " SELECT * FROM near",
    "recommend_songs": _page("combined", "all", 1, 10, "10.0"),
    "recommend_songs_page2": _page("combined", "all", 11, 20, "10.0"),
    "recommend_artists": _page("follow", "all", 1, 10, "1.0"),
    "recommend_likes": _page("likes", "raters", 1, 5, "1.0"),
    "recommend_plays": _page("plays", "raters", 1, 5, "1.0"),
    "recommend_report": f"""WITH {EDGES}, {_lists("a", "likes")}, {_lists("b", "plays")}
      SELECT coalesce(a.user_id, b.user_id) AS user_id,
        CASE WHEN b.user_id IS NOT NULL THEN a.users END AS similar_users,
        CASE WHEN b.user_id IS NOT NULL THEN a.items END AS recommended_songs,
        CASE WHEN a.user_id IS NOT NULL THEN b.users END AS similar_play_users,
        CASE WHEN a.user_id IS NOT NULL THEN b.items END AS recommendations_play,
        CASE WHEN a.user_id IS NULL OR b.user_id IS NULL THEN 'unknown user' END AS error
      FROM a FULL JOIN b ON a.user_id = b.user_id""",
    "recommend_one_user_full_catalog": _rec("combined", "all")
    + f""" SELECT CAST({ONE_USER} AS BIGINT) AS user_id, p_partkey AS item_id, coalesce(w, 0) / 10.0 AS score,
        CAST(row_number() OVER (ORDER BY coalesce(w, 0) DESC, p_partkey) AS INTEGER) AS rank
      FROM part LEFT JOIN scored ON item_id = p_partkey AND user_id = {ONE_USER}
      WHERE p_partkey NOT IN (SELECT item_id FROM r WHERE user_id = {ONE_USER})""",
    "neighbor_item_union": _near("likes", "raters", 10)
    + " SELECT DISTINCT n.user_id, r.item_id FROM near n JOIN r ON r.user_id = n.other_id",
    "song_cards": f"""WITH {EDGES}, {SONG}, {CARDS} SELECT CAST(s.id AS VARCHAR) AS id, title, released AS "releaseDate", duration,
        created AS "createdAt", opened AS path, album.x AS albums, coalesce(xs, '') AS artists
      FROM song s JOIN album USING (p_brand) LEFT JOIN artists ON l_partkey = s.id WHERE s.id IN (SELECT item_id FROM likes)""",
    "artist_cards": f"""WITH {EDGES}, {CARDS} SELECT id, name, avatar, genres FROM acard
      WHERE s_suppkey IN (SELECT item_id FROM follows)""",
    "recommended_song_cards": _rec("combined", "all")
    + f""", {SONG}, {CARDS} SELECT user_id, rank, CAST(id AS VARCHAR) AS id, title, duration, 1 AS albums,
        CAST(coalesce(c, 0) AS INTEGER) AS artists
      FROM rec JOIN song ON id = item_id LEFT JOIN artists ON l_partkey = id WHERE rank <= 10""",
    "recommended_artist_cards": _rec("follow", "all")
    + f", {CARDS} SELECT user_id, rank, id, name, avatar, genres FROM rec JOIN acard ON s_suppkey = item_id WHERE rank <= 10",
    "local_time_text": "SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%m/%d/%Y %H:%M:%S') AS local_time FROM events",
    "media_url": f"WITH {USER} SELECT id, url FROM person",
    "secure_media_path": f"""WITH {SONG},
      one AS (SELECT id, path, opened AS payload, {SECRET} AS secret FROM song WHERE path LIKE '%{MEDIA.marker}%'),
      two AS (SELECT *, unhex(md5(secret)) AS d1 FROM one),
      three AS (SELECT *, unhex(md5(d1 || secret)) AS d2 FROM two)
      SELECT id, hex(d1 || d2) AS key, upper(md5(d2 || secret)) AS iv,
        CAST(4 * ceil((16 + 16 * (length(payload) // 16 + 1)) / 3.0) AS INTEGER) AS sealed_chars, payload FROM three
      UNION ALL SELECT id, NULL, NULL, CAST(length(path) AS INTEGER), path FROM song WHERE path NOT LIKE '%{MEDIA.marker}%'""",
    "moderation_scores": SCORES,
    "moderation_scores_model": SCORES,
    "moderation_scores_batched": SCORES,
    "moderation_summary": f"""WITH {COMMENTS} SELECT blocked, coalesce(CAST(l.toxic AS VARCHAR), 'none') AS label, count(*) AS comments
      FROM scored s LEFT JOIN labels l ON l.doc_id = s.id GROUP BY 1, 2""",
    "moderated_comments": STORED,
    "moderation_reports": f"""WITH {COMMENTS} SELECT substr(sha256('report:' || id), 1, 32) AS id, CAST(NULL AS VARCHAR) AS "userId",
        id AS "commentId", '{REPORT_TEXT}' AS content, '{REPORT_STATUS}' AS status, shown AS "createdAt", shown AS "updatedAt"
      FROM scored WHERE blocked""",
    "accepted_comment_cards": f"""WITH {COMMENTS}, {USER}
      SELECT s.id, CAST(parent AS VARCHAR) AS "commentParentId", CAST(user_id AS VARCHAR) AS "userId",
        CAST(song_id AS VARCHAR) AS "songId", content, false AS hide, shown AS "createdAt", shown AS "updatedAt",
        username AS user_username, email AS user_email, url AS user_image, role AS user_role, username AS user_name,
        true AS "myComment", toxic FROM scored s JOIN person p ON p.id = user_id WHERE NOT blocked""",
    "moderation_outcomes": f"""WITH {COMMENTS} SELECT id, CASE WHEN blocked THEN 'error' ELSE 'success' END AS status,
        CASE WHEN blocked THEN '{BLOCKED_MESSAGE}' ELSE '{ACCEPTED_MESSAGE}' END AS message, toxic FROM scored""",
    "stream_moderation": STORED,
    "stream_reports": f"""WITH {COMMENTS} SELECT substr(sha256('report:' || id), 1, 32) AS id, CAST(NULL AS VARCHAR) AS "userId",
        id AS "commentId", '{REPORT_TEXT}' AS content, '{REPORT_STATUS}' AS status, shown AS "createdAt", shown AS "updatedAt",
        content AS comment, true AS hide FROM scored WHERE blocked""",
    "stream_ratings": """SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id,
        CAST(sum(CASE event_type WHEN 'purchase' THEN 10 ELSE 1 END) AS BIGINT) AS w
      FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2""",
}
