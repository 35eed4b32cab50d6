"""Topology from traceroute paths: hops, vertices and edges, pruning, merging, distances. Graphs are tables, and steps are joins."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.text import as_category, ipv4_number, zip_hops
from pulseframe.operators.components import components
from pulseframe.operators.scratch import checkpoint_folder, written


def traceroute_paths(traceroutes: DataFrame, metas: DataFrame, paths: DataFrame, as_paths: DataFrame, latest: bool = False) -> DataFrame:
    """Traceroutes (stream, path_id, aspath_id, time) with meta (source, destination; required), path (addresses; required) and AS path (optional), as hops.

    With ``latest`` each path once, at its last time, which is all that
    vertices and edges need: they grow with the paths, not the traceroutes.
    """
    if latest:
        traceroutes = traceroutes.groupBy("stream", "path_id", "aspath_id").agg(F.max("time").alias("time"))
    rows = traceroutes.join(metas.select("stream", "source", "destination"), "stream").join(paths.select("stream", "path_id", "path"), ["stream", "path_id"]).join(as_paths.select("stream", "aspath_id", "aspath"), ["stream", "aspath_id"], "left")
    return rows.select("stream", "path_id", "time", "source", "destination", zip_hops(F.col("path"), F.col("aspath")).alias("hops"))


def _host(hop: Column, i: Column, n: Column) -> Column:
    """A hop's host: the first is the named source, the last the named destination; without name and address it is known by where it is."""
    name = F.when(i == 0, F.col("source")).when(i == n - 1, F.col("destination"))
    address, number = hop["address"], hop["as_number"]
    uid = F.coalesce(name, F.when(address.isNotNull(), F.concat(F.lit("("), address, F.lit(","), number.cast("string"), F.lit(")"))), F.concat(F.lit("("), F.col("stream").cast("string"), F.lit(","), F.col("path_id").cast("string"), F.lit(","), i.cast("string"), F.lit(")")))
    return F.struct(uid.alias("uid"), name.alias("hostname"), address.alias("address"), number.alias("as_number"), (name.isNull() & address.isNull()).alias("anonymous"))


def with_hosts(paths: DataFrame) -> DataFrame:
    n = F.size("hops")
    return paths.withColumn("hosts", F.transform("hops", lambda h, i: _host(h, i, n)))


def change_events(paths: DataFrame) -> DataFrame:
    """The log of changes: a vertex for each hop, an edge for each adjacent pair, an end marker for each path; seq is their order within a path."""
    rows = with_hosts(paths)
    n = F.size("hosts")
    entry = lambda seq, op, a, b: F.struct(seq.cast("long").alias("seq"), F.lit(op).alias("op"), a.alias("src"), b.alias("dst"))
    none = F.lit(None).cast("string")
    vertices = F.transform("hosts", lambda h, i: entry(i, "add_vertex", h["uid"], none))
    edges = F.transform(F.slice("hosts", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda h, i: entry(n + i, "add_or_update_edge", h["uid"], F.element_at("hosts", i + 2)["uid"]))
    end = F.array(entry(2 * n, "end", none, none))
    return rows.select("stream", "path_id", "time", F.explode(F.concat(vertices, edges, end)).alias("e")).select("stream", "path_id", "time", "e.*")


def vertices(paths: DataFrame) -> DataFrame:
    """The hosts, merged by uid."""
    hosts = with_hosts(paths).select(F.explode("hosts").alias("h")).select("h.*")
    return merge_hosts(hosts, F.col("uid"))


def merge_hosts(hosts: DataFrame, by: Column) -> DataFrame:
    """Hosts (hostname, address, as_number, anonymous) merged by a key: names and addresses together; a host is anonymous only if all are."""
    return hosts.groupBy(by.alias("uid")).agg(F.array_sort(F.collect_set("hostname")).alias("hostnames"), F.array_sort(F.collect_set(F.when(F.col("address").isNotNull(), F.struct("address", "as_number")))).alias("addresses"), F.min("anonymous").alias("anonymous"))


def edges(changes: DataFrame) -> DataFrame:
    """Each edge with when it was last seen: at the last change in order of arrival."""
    rows = changes.where("op = 'add_or_update_edge' and src <> dst")
    return rows.groupBy("src", "dst").agg(F.max_by("time", F.struct("time", "stream", "path_id", "seq")).alias("last_seen"))


def degrees(edges: DataFrame) -> DataFrame:
    """How many edges leave each vertex."""
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def relabel(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges after vertices have become one: aliases (uid, canonical). Self loops go, of parallel edges the latest stays."""
    a = aliases.select(F.col("uid").alias("_u"), F.col("canonical").alias("_c"))
    out = edges.join(a, F.col("src") == F.col("_u"), "left").withColumn("src", F.coalesce("_c", "src")).drop("_u", "_c")
    out = out.join(a, F.col("dst") == F.col("_u"), "left").withColumn("dst", F.coalesce("_c", "dst")).drop("_u", "_c")
    return out.where("src <> dst").groupBy("src", "dst").agg(F.max("last_seen").alias("last_seen"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the largest weakly connected component; of equals, that with the smallest vertex. The edges are written once, since they are read twice."""
    edges = written(edges, "edges")
    parts = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), stored=True)
    sizes = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = parts.join(F.broadcast(sizes.select("component")), "component").select(F.col("node").alias("src"))
    return edges.join(inside, "src", "left_semi")


def prune_last_seen(edges: DataFrame, now: Column, age_s: float) -> DataFrame:
    """Edges seen within ``age_s`` before now, and of these the largest component."""
    return largest_component(edges.where(F.unix_millis("last_seen") >= F.unix_millis(now) - round(age_s * 1000)))


def resolve_aliases(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of names of one host as aliases (uid, canonical): the smallest name stands for all."""
    return components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("uid"), F.col("component").alias("canonical"))


def itdk_aliases(hosts: DataFrame, nodes: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Hosts (uid, address) with the node their address belongs to, and that node's AS number, 0 if unknown. Hosts under two nodes are an error."""
    found = hosts.join(nodes.select(F.col("ip").alias("address"), "node_id"), "address").groupBy("uid").agg(F.min("node_id").alias("node_id"), F.max("node_id").alias("_other"))
    checked = F.when(F.col("node_id") == F.col("_other"), F.col("node_id")).otherwise(F.raise_error(F.concat(F.lit("two nodes for "), F.col("uid"))).cast("long"))
    out = found.select("uid", checked.alias("node_id"), F.concat(F.lit("N"), F.col("node_id").cast("string")).alias("canonical"))
    return out if numbers is None else node_numbers(out, numbers)


def node_numbers(nodes: DataFrame, numbers: DataFrame) -> DataFrame:
    return nodes.join(numbers.select("node_id", "as_number"), "node_id", "left").withColumn("as_number", F.coalesce("as_number", F.lit(0)))


def node_places(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """Nodes (node_id) with the place that is known of them; those without any are kept."""
    return nodes.join(places, "node_id", "left")


def node_of_ip(ips: DataFrame, nodes: DataFrame) -> DataFrame:
    """IPs with their node, in order of their octets."""
    return ips.join(nodes, "ip", "left").orderBy(ipv4_number(F.col("ip")))


def parallel_anonymous(edges: DataFrame, anonymous: DataFrame) -> DataFrame:
    """Aliases (uid, canonical) of anonymous hosts that take the same place on parallel paths.

    From each named vertex with several parents, each parent's only-parent
    chain is followed up to the first vertex with several children, however
    far; vertices of one parent and one child can't form a circle above
    another vertex, so the walk ends. All paths down from there, up to three
    longer than the chain, whose inner vertices are all anonymous are grouped
    by length, start and end; in groups of several, the vertices at each place
    are one. Paths grow by one join a step and only through anonymous
    vertices, so their number follows the branching there.
    """
    checkpoint_folder(edges.sparkSession)
    pairs = edges.select("src", "dst").distinct()
    out_degree = pairs.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("out"))
    in_degree = pairs.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("in"), F.min("src").alias("parent"))
    hidden = anonymous.select(F.col("uid").alias("v")).distinct()
    named = in_degree.where(F.col("in") > 1).join(hidden, "v", "left_anti").select(F.col("v").alias("target"))
    walk = pairs.join(named, F.col("dst") == F.col("target")).select("target", F.col("src").alias("v"), F.lit(0).alias("depth"))
    found = None
    for step in count(1):
        here = walk.join(out_degree, "v", "left").join(in_degree, "v", "left").checkpoint()
        stop = here.where(F.col("out") > 1).select("target", F.col("v").alias("start"), "depth")
        found = stop if found is None else found.unionByName(stop)
        walk = here.where((F.coalesce("out", F.lit(0)) <= 1) & (F.col("in") == 1)).select("target", F.col("parent").alias("v"), (F.col("depth") + 1).alias("depth"))
        if walk.isEmpty():
            break
        if step % 16 == 0:  # else the plan grows with each step
            found = found.checkpoint()
    ancestors = found.groupBy("target", "start").agg((F.max("depth") + 3).alias("most")).checkpoint()
    grow = ancestors.select("target", "most", "start", F.array("start").alias("path"), F.col("start").alias("end"))
    done = None
    while True:
        grow = grow.join(pairs, F.col("end") == F.col("src")).where((F.size("path") <= F.col("most")) & ~F.array_contains("path", F.col("dst")))
        grow = grow.select("target", "most", "start", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end")).checkpoint()
        there = grow.where(F.col("end") == F.col("target")).select("start", "target", "path")
        done = there if done is None else done.unionByName(there)
        grow = grow.where(F.col("end") != F.col("target")).join(hidden.select(F.col("v").alias("end")), "end", "left_semi")
        if grow.isEmpty():
            break
    places = done.distinct().select("start", "target", F.size("path").alias("n"), F.posexplode(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))).alias("place", "uid"))
    first = places.groupBy("start", "target", "n", "place").agg(F.min("uid").alias("first"))
    same = places.join(first, ["start", "target", "n", "place"]).select(F.col("uid").alias("a"), F.col("first").alias("b"))
    return resolve_aliases(same)


def hop_distances(edges: DataFrame, origins: DataFrame, most: int | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(origin, node, hops) of undirected shortest paths from origins (uid), if given up to ``most`` hops: one join a hop, over what the last hop reached.

    With ``ends`` (uid) only the paths to these are whole: the search is over
    once each origin has reached all of them, or nothing new is reached.
    """
    checkpoint_folder(edges.sparkSession)
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = origins.select(F.col("uid").alias("origin"), F.col("uid").alias("node")).distinct().withColumn("hops", F.lit(0)).checkpoint()
    front = seen
    ends = None if ends is None else ends.select(F.col("uid").alias("node")).distinct()
    pairs_wanted = None if ends is None else seen.count() * ends.count()
    for hop in count(1) if most is None else range(1, most + 1):
        front = front.join(pairs, F.col("node") == F.col("a")).select("origin", F.col("b").alias("node")).distinct().join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("hops", F.lit(hop)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if ends is not None and seen.join(ends, "node", "left_semi").count() == pairs_wanted:
            break
        if hop % 16 == 0:  # else the plan grows with each hop
            seen = seen.checkpoint()
    return seen


_WORDS = 16  # of 64 origins each in a row of end_distances


def end_distances(edges: DataFrame, ends: DataFrame, most: int | None = None) -> DataFrame:
    """(origin, node, hops) of undirected shortest paths between all of ends (uid) that are connected, if given up to ``most`` hops.

    The search from all ends goes side by side: a row has a node and, as bits,
    which of 1024 ends of its component have reached it. So a hop costs the
    edges times the thousands of ends in their component, not the number of
    paths. A component is over once its ends have all reached each other.
    """
    ids, bits = ["node", "component", "chunk"], [f"b{i}" for i in range(_WORDS)]
    pairs = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    pairs = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    parts = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    ends = ends.select(F.col("uid").alias("node")).where("node is not null").distinct().join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    number = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
    ends = written(ends.withColumn("i", number.cast("long")), "ends")
    whole = ends.groupBy("component").agg((F.count("*") * F.count("*")).alias("wanted"))
    at = F.col("i") % (64 * _WORDS)
    bit = lambda w: F.when(F.floor(at / 64) == w, F.expr("shiftleft(1L, cast(i % 64 as int))")).otherwise(F.lit(0).cast("long"))
    seen = written(ends.select("node", "component", F.floor(F.col("i") / (64 * _WORDS)).alias("chunk"), *(bit(w).alias(b) for w, b in enumerate(bits))), "seen")
    front, here = seen, ends.select("node")
    found = [seen.withColumn("hops", F.lit(0))]
    for hop in count(1) if most is None else range(1, most + 1):
        none = [F.lit(0).cast("long").alias(f"o{b}") for b in bits]
        reached = front.join(pairs, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "component", "chunk", *bits, *none)
        known = seen.select(*ids, *bits, *(F.col(b).alias(f"o{b}") for b in bits))
        state = written(reached.unionByName(known).groupBy(*ids).agg(*(F.bit_or(b).alias(b) for b in [*bits, *(f"o{b}" for b in bits)])), "state")
        new = [F.col(b).bitwiseAND(F.bitwise_not(f"o{b}")).alias(b) for b in bits]
        changed = F.expr(" or ".join(f"{b} <> o{b}" for b in bits))
        seen, front = state.select(*ids, *bits), state.where(changed).select(*ids, *new)
        found.append(front.join(here, "node", "left_semi").withColumn("hops", F.lit(hop)))
        have = seen.join(here, "node", "left_semi").groupBy("component").agg(F.sum(F.expr(" + ".join(f"cast(bit_count({b}) as long)" for b in bits))).alias("have"))
        open_ = written(have.join(whole, "component").where("have < wanted").select("component"), "open")
        front = front.join(open_, "component", "left_semi")
        if front.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, found).select("node", "component", "chunk", "hops", F.posexplode(F.array(*bits)).alias("word", "w")).where("w <> 0")
    rows = rows.select("node", "component", "chunk", "hops", "word", F.explode(F.expr("filter(sequence(0, 63), x -> getbit(w, x) = 1)")).alias("x"))
    rows = rows.withColumn("i", F.col("chunk") * (64 * _WORDS) + F.col("word") * 64 + F.col("x"))
    return rows.join(ends.select(F.col("node").alias("origin"), "component", "i"), ["component", "i"]).select("origin", "node", "hops")


def stream_distances(edges: DataFrame, metas: DataFrame, most: int | None = None, documented: bool = False) -> DataFrame:
    """(a, b, distance) of all pairs of streams (stream, source, destination) that are connected, if given by at most ``most`` hops.

    The distance is that of the sources, twice, as it is known to work; with
    ``documented`` that of the sources and that of the destinations. The
    pairs are those of the streams, whose number metadata bounds.
    """
    names = metas.select(F.col("source").alias("uid")).unionByName(metas.select(F.col("destination").alias("uid"))).distinct()
    hops = end_distances(edges, names, most)
    a = metas.select(F.col("stream").alias("a"), F.col("source").alias("sa"), F.col("destination").alias("da"))
    b = metas.select(F.col("stream").alias("b"), F.col("source").alias("sb"), F.col("destination").alias("db"))
    near = a.join(hops, F.col("sa") == F.col("origin")).select("a", "da", F.col("node").alias("sb"), F.col("hops").alias("first")).join(b, "sb").where("a <> b")
    if not documented:
        return near.select("a", "b", (2 * F.col("first")).cast("double").alias("distance"))
    far = hops.select(F.col("origin").alias("da"), F.col("node").alias("db"), F.col("hops").alias("second"))
    return near.join(far, ["da", "db"]).select("a", "b", (F.col("first") + F.col("second")).cast("double").alias("distance"))


def _hex(hue: Column, saturation: float = 0.5, brightness: float = 0.95) -> Column:
    """A colour of that hue (0 to 1) as #RRGGBB."""
    sector = F.floor(hue * 6)
    part = hue * 6 - sector
    levels = {
        "v": F.lit(brightness), "p": F.lit(brightness * (1 - saturation)),
        "q": brightness * (1 - saturation * part), "t": brightness * (1 - saturation * (1 - part)),
    }
    two = {k: F.lpad(F.hex(F.floor(x * 255 + 0.5)), 2, "0") for k, x in levels.items()}
    ways = ("vtp", "qvp", "pvt", "pqv", "tpv", "vpq")  # red, green and blue in each sixth of the circle
    colours = F.array(*(F.concat(F.lit("#"), *(two[k] for k in way)) for way in ways))
    return F.element_at(colours, (F.pmod(sector, F.lit(6)) + 1).cast("int"))


def as_colours(vertices: DataFrame) -> DataFrame:
    """Each valid AS number of the vertices with a colour; the hues are spread evenly in order of the numbers, of which there are few beside the vertices."""
    numbers = vertices.select(F.explode("addresses").alias("a")).select(F.col("a.as_number").alias("as_number")).where("as_number > 0").distinct()
    rank = F.row_number().over(Window.orderBy("as_number")) - 1
    hue = F.lit(0.8) * rank / F.count("*").over(Window.partitionBy()) + 0.1
    return numbers.withColumn("colour", _hex(hue))


def dot_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph in DOT, a row a line with its part and key, to be written in that order.

    Boxes are hosts that look like monitors; hosts with names are red, others
    have the colour of their smallest AS number, or are white.
    """
    first = F.array_min(F.filter(F.col("addresses.as_number"), lambda n: n > 0))
    vertices = vertices.withColumn("_as", first).join(as_colours(vertices).withColumnRenamed("as_number", "_n"), F.col("_as") == F.col("_n"), "left")
    shape = F.when(F.exists("hostnames", lambda h: h.contains("amp")), "box").otherwise("oval")
    fill = F.when(F.size("hostnames") > 0, "#FF0000").otherwise(F.coalesce("colour", F.lit("#FFFFFF")))
    style = F.concat(F.lit("style=filled, shape="), shape, F.lit(', fillcolor="'), fill, F.lit('"'))
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    one = lambda part, text: vertices.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit("").alias("key"), F.lit(text).alias("line"))
    node = F.concat(F.lit("  "), quote(F.col("uid")), F.lit(" ["), style, F.lit("];"))
    nodes = vertices.select(F.lit(1).alias("part"), F.col("uid").alias("key"), node.alias("line"))
    link = F.concat(F.lit("  "), quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(";"))
    links = edges.select(F.lit(2).alias("part"), F.concat_ws("|", "src", "dst").alias("key"), link.alias("line"))
    return one(0, "strict digraph G {").unionByName(nodes).unionByName(links).unionByName(one(3, "}"))


def topology(traceroutes: DataFrame, metas: DataFrame, paths: DataFrame, as_paths: DataFrame, nodes: DataFrame | None = None, age_s: float = 1200) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the graph that traceroutes make, by all steps in a row.

    Paths are joined and turned into changes, these are folded to edges; with
    ``nodes`` (node_id, ip) hosts of one router become one; edges not seen for
    ``age_s`` before the last are pruned, and all but the largest component;
    anonymous hosts at the same place of parallel paths become one.
    """
    routes = traceroute_paths(traceroutes, metas, paths, as_paths, latest=True)
    hosts = with_hosts(routes).select(F.explode("hosts").alias("h")).select("h.*").distinct()
    links = edges(change_events(routes))
    if nodes is not None:
        aliases = itdk_aliases(hosts.where("address is not null").select("uid", "address").distinct(), nodes)
        links, hosts = relabel(links, aliases), _renamed(hosts, aliases)
    links = written(links, "links")
    links = written(prune_last_seen(links.crossJoin(F.broadcast(links.agg(F.max("last_seen").alias("now")))), F.col("now"), age_s).drop("now"), "links")
    merged = written(merge_hosts(hosts, F.col("uid")), "hosts")
    aliases = parallel_anonymous(links, merged.where("anonymous").select("uid"))
    links = relabel(links, aliases)
    hosts = _renamed(hosts, aliases)
    there = links.select(F.col("src").alias("uid")).unionByName(links.select(F.col("dst").alias("uid"))).distinct()
    return merge_hosts(hosts, F.col("uid")).join(there, "uid", "left_semi"), links


def _renamed(hosts: DataFrame, aliases: DataFrame) -> DataFrame:
    names = aliases.select(F.col("uid").alias("_u"), F.col("canonical").alias("_c"))
    return hosts.join(names, F.col("uid") == F.col("_u"), "left").withColumn("uid", F.coalesce("_c", "uid")).drop("_u", "_c")


def category_counts(vertices: DataFrame) -> DataFrame:
    """How many addresses have an AS number of each category."""
    return vertices.select(F.explode("addresses").alias("a")).groupBy(as_category(F.col("a.as_number")).alias("category")).agg(F.count("*").alias("n"))
