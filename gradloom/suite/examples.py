"""Row preparation, scoring, losses, gradients and objectives over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradloom.functions import losses as L
from gradloom.operators import gradients as G
from gradloom.operators import rows as P
from gradloom.operators import scoring as S
from gradloom.operators.batches import BatchCycle
from gradloom.plans import objectives as O
from gradloom.schemas import class_violations, vector_violations
from gradloom.suite.base import (
    CLASSES,
    CTES,
    EMBED_DIM,
    R,
    case,
    dim,
    ex_bin,
    ex_multi,
    ex_reg,
    fea,
    fea_emb,
    fea_nobias,
    MANY,
    many_classes,
    m0,
    pot0,
    rank_pos,
    rank_sampler,
    read,
    rnd,
    rows_of,
    w0,
)

SIG = "1 / (1 + exp(-s.score))"
# loss and slope of every point loss, over e (label, weight) and s (score)
POINT_SQL = {
    "l2": ("e.weight * (s.score - e.label) * (s.score - e.label)", "2 * e.weight * (s.score - e.label)"),
    "quantile": (
        "e.weight * CASE WHEN s.score < e.label THEN (0.3 - 1) * (s.score - e.label) ELSE 0.3 * (s.score - e.label) END",
        "e.weight * CASE WHEN s.score < e.label THEN 0.3::DOUBLE - 1 ELSE 0.3::DOUBLE END",
    ),
    "binlog": (
        f"CASE WHEN e.label THEN -e.weight * ln({SIG} + 1e-24) ELSE -e.weight * ln(1 - {SIG} + 1e-24) END",
        f"CASE WHEN e.label THEN -e.weight * (1 - {SIG}) ELSE e.weight * {SIG} END",
    ),
}
POINT = {"l2": (L.SQUARED, "ex_reg"), "quantile": (L.quantile(0.3), "ex_reg"), "binlog": (L.LOGISTIC, "ex_bin")}

for _name, (_value, _slope) in POINT_SQL.items():
    CTES[f"loss_{_name}"] = f"""SELECT e.ex_id, {_value} AS loss, {_slope} AS dscore, e.weight
      FROM {POINT[_name][1]} e JOIN score0 s ON e.ex_id = s.ex_id"""
    CTES[f"grad_{_name}"] = f"""SELECT w.idx, coalesce(g.g, 0.0::DOUBLE) / (SELECT sum(weight) FROM loss_{_name}) AS g FROM w0 w
      LEFT JOIN (SELECT f.fea_id, sum(f.value * l.dscore) AS g FROM fea f JOIN loss_{_name} l ON f.ex_id = l.ex_id GROUP BY 1) g
      ON g.fea_id = w.idx"""


# --- row preparation -------------------------------------------------------------


@case("index_examples", "SELECT o_orderkey AS ex_id, o_orderkey % 5 AS fold FROM orders")
def index_examples(spark, sf):
    orders = read(spark, sf, "orders")
    fold = F.col("o_orderkey") % 5
    named = orders.select(F.concat(F.lit("fold"), fold, F.lit("_"), F.col("o_orderkey")).alias("ex_id"), fold.alias("fold"))
    return P.index_examples(named)


@case(
    "default_weight",
    "SELECT o_orderkey AS ex_id, CASE WHEN o_custkey % 4 = 0 THEN 1.0::DOUBLE ELSE (o_custkey % 4)::DOUBLE END AS weight FROM orders",
)
def default_weight(spark, sf):
    weight = F.when(F.col("o_custkey") % 4 != 0, (F.col("o_custkey") % 4).cast("double"))
    return P.default_weight(read(spark, sf, "orders").select(F.col("o_orderkey").alias("ex_id"), weight.alias("weight")))


def _nested(spark, sf):
    """Example rows with an array of features; repeated lines repeat a feature."""
    lines = read(spark, sf, "lineitem")
    entry = F.struct((F.col("l_partkey") + 1).alias("fea_id"), (F.col("l_quantity") / 50.0).alias("value"))
    arrays = lines.groupBy(F.col("l_orderkey").alias("ex_id")).agg(F.collect_list(entry).alias("features"))
    return ex_reg(spark, sf).join(arrays, "ex_id")


@case("distribute_features", f"SELECT ex_id, fea_id, {R('value')} AS value FROM fea_nobias")
def distribute_features(spark, sf):
    out = P.distribute_features(_nested(spark, sf))
    return out.select("ex_id", "fea_id", rnd("value").alias("value"))


@case(
    "distribute_features_blocked",
    """SELECT ex_id, fea_id // 64 AS fea_block, count(*) AS n, min(fea_id % 64) AS first_offset,
    string_agg((fea_id % 64)::VARCHAR, ',' ORDER BY fea_id) AS offsets FROM fea_nobias GROUP BY 1, 2""",
)
def distribute_features_blocked(spark, sf):
    blocks = P.block_features(fea_nobias(spark, sf), 64)
    offsets = F.transform("entries", lambda e: e["offset"].cast("string"))
    return blocks.select(
        "ex_id",
        "fea_block",
        F.size("entries").cast("bigint").alias("n"),
        F.col("entries")[0]["offset"].alias("first_offset"),
        F.array_join(offsets, ",").alias("offsets"),
    )


@case(
    "distribute_targets",
    f"""SELECT e.ex_id, {R('label')} AS label, weight, b.blocks FROM ex_reg e JOIN (
    SELECT ex_id, string_agg(blk::VARCHAR, ',' ORDER BY blk) AS blocks
    FROM (SELECT DISTINCT ex_id, fea_id // 64 AS blk FROM fea_nobias) GROUP BY 1) b ON b.ex_id = e.ex_id""",
)
def distribute_targets(spark, sf):
    out = P.distribute_targets(_nested(spark, sf), 64)
    blocks = F.array_join(F.transform("fea_blocks", lambda b: b.cast("string")), ",")
    return out.select("ex_id", rnd("label").alias("label"), "weight", blocks.alias("blocks"))


@case("split_potentials", f"SELECT 'u' AS part, idx, {R('p')} AS p FROM pot0 WHERE side = 'u' UNION ALL SELECT 'v', idx, {R('p')} FROM pot0 WHERE side = 'v'")
def split_potentials(spark, sf):
    u, v = P.split_potentials(pot0(spark, sf))
    tagged = [df.select(F.lit(t).alias("part"), "idx", rnd("p").alias("p")) for t, df in (("u", u), ("v", v))]
    return tagged[0].unionByName(tagged[1])


@case(
    "split_pos_neg",
    """SELECT 'pos' AS kind, link_id, ex_id, item FROM rank_pos
    UNION ALL SELECT 'neg', link_id, ex_id, item FROM rank_neg""",
)
def split_pos_neg(spark, sf):
    from gradloom.operators.ranking import neg_sample

    pos = rank_pos(spark, sf)
    neg = neg_sample(pos, 3, 5, rank_sampler(rows_of(spark, sf, "part")))
    cols = ["link_id", "ex_id", "item"]
    both = pos.select(*cols, F.lit(True).alias("is_positive")).unionByName(neg.select(*cols, F.lit(False).alias("is_positive")))
    kinds = [df.select(F.lit(t).alias("kind"), *cols) for t, df in (("pos", P.positive_labels(both)), ("neg", P.negative_labels(both)))]
    return kinds[0].unionByName(kinds[1])


@case(
    "validate_vector",
    """SELECT idx, n, reason FROM (SELECT idx, count(*) AS n, max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS bad,
    CASE WHEN idx < 0 OR idx >= (SELECT max(p_partkey) - 10 FROM part) THEN 'index'
      WHEN max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) = 1 THEN 'value' WHEN count(*) > 1 THEN 'repeated' END AS reason
    FROM (SELECT l_partkey - 3 AS idx, CASE WHEN l_quantity <> 7 THEN l_quantity END AS v FROM lineitem
          WHERE l_linenumber = 1 AND l_tax = 0) GROUP BY 1) WHERE reason IS NOT NULL""",
)
def validate_vector(spark, sf):
    return part_violations(spark, sf, read(spark, sf, "lineitem").filter((F.col("l_linenumber") == 1) & (F.col("l_tax") == 0)))


@case(
    "validate_vector_all",
    """SELECT idx, n, reason FROM (SELECT idx, count(*) AS n,
    CASE WHEN idx < 0 OR idx >= (SELECT max(p_partkey) - 10 FROM part) THEN 'index'
      WHEN count(*) > count(v) THEN 'value' WHEN count(*) > 1 THEN 'repeated' END AS reason
    FROM (SELECT l_partkey - 3 AS idx, CASE WHEN l_quantity <> 7 THEN l_quantity END AS v FROM lineitem) GROUP BY 1) WHERE reason IS NOT NULL""",
)
def validate_vector_all(spark, sf):
    return part_violations(spark, sf, read(spark, sf, "lineitem"))


def part_violations(spark, sf, lines):
    rows = lines.select((F.col("l_partkey") - 3).alias("idx"), F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("v"))
    size = read(spark, sf, "part").agg(F.max("p_partkey")).first()[0] - 10
    return vector_violations(rows, size)


@case("validate_classes", "SELECT ex_id, cls FROM ex_multi WHERE cls < 0 OR cls >= 8")
def validate_classes(spark, sf):
    return class_violations(ex_multi(spark, sf), 8).select("ex_id", "cls")


@case("total_weight", f"SELECT {R('sum(weight)', 4)} AS total_weight FROM ex_reg")
def total_weight(spark, sf):
    return P.total_weight(ex_reg(spark, sf)).select(rnd("total_weight", 4).alias("total_weight"))


# --- scoring -----------------------------------------------------------------------


def scores(spark, sf):
    return S.score_linear(fea(spark, sf), w0(spark, sf), dim(spark, sf))


@case("score_linear", f"SELECT ex_id, {R('score')} AS score FROM score0")
def score_linear(spark, sf):
    return scores(spark, sf).select("ex_id", rnd("score").alias("score"))


@case(
    "score_linear_featureless",
    f"""SELECT e.ex_id, {R('coalesce(s.score, 0)')} AS score FROM ex_reg e LEFT JOIN (
    SELECT ex_id, sum(value * v) AS score FROM fea_nobias JOIN w0 ON fea_id = idx GROUP BY 1) s ON s.ex_id = e.ex_id""",
)
def score_linear_featureless(spark, sf):
    """Examples without any feature score 0."""
    scored = S.score_linear(fea_nobias(spark, sf), w0(spark, sf), dim(spark, sf))
    return S.with_all(ex_reg(spark, sf), scored, ["score"]).select("ex_id", rnd("score").alias("score"))


@case("score_linear_spread", f"SELECT ex_id, {R('score')} AS score FROM score0")
def score_linear_spread(spark, sf):
    """The plan for weights too large to broadcast: shuffled, hot features split."""
    return S.score_linear(fea(spark, sf), w0(spark, sf), None).select("ex_id", rnd("score").alias("score"))


@case("score_linear_multi", f"SELECT ex_id, k, {R('score')} AS score FROM mscore")
def score_linear_multi(spark, sf):
    wide = S.score_linear_multi(fea_emb(spark, sf), m0(spark, sf), CLASSES, EMBED_DIM)
    return S.scores_long(wide, CLASSES).select("ex_id", "k", rnd("score").alias("score"))


# A factorization machine over the order features, three factors.
CTES["fm_v"] = "SELECT idx, k::INTEGER AS k, ((idx * 11 + k * 5) % 19 - 9) / 23.0::DOUBLE AS v FROM w0, range(3) t(k)"
CTES["fm_sum"] = """SELECT ex_id, k, sum(value * v) AS s, sum(value * value * v * v) AS q
  FROM fea JOIN fm_v ON fea_id = idx GROUP BY 1, 2"""


def fm_v(spark, sf):
    cells = w0(spark, sf).select("idx", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return cells.select("idx", "k", (((F.col("idx") * 11 + F.col("k") * 5) % 19 - 9) / 23.0).alias("v"))


@case("score_fm", f"SELECT ex_id, {R('0.5 * sum(s * s - q)')} AS score FROM fm_sum GROUP BY 1")
def score_fm(spark, sf):
    return S.score_fm(fea(spark, sf), fm_v(spark, sf), 3, dim=dim(spark, sf)).select("ex_id", rnd("score").alias("score"))


@case(
    "fm_backprop",
    f"""SELECT f.ex_id, f.fea_id, v.k, {R('f.value * (s.s - v.v * f.value)')} AS grad
    FROM fea f JOIN fm_v v ON f.fea_id = v.idx JOIN fm_sum s ON s.ex_id = f.ex_id AND s.k = v.k""",
)
def fm_backprop(spark, sf):
    out = S.fm_backprop(fea(spark, sf), fm_v(spark, sf), 3, dim(spark, sf))
    return out.select("ex_id", "fea_id", "k", rnd("grad").alias("grad"))


# --- losses and gradients ------------------------------------------------------------


def examples_for(spark, sf, name):
    return ex_bin(spark, sf) if POINT[name][1] == "ex_bin" else ex_reg(spark, sf)


def losses_for(spark, sf, name):
    return G.point_losses(examples_for(spark, sf, name), scores(spark, sf), POINT[name][0])


def _loss_case(name):
    @case(f"loss_{name}", f"SELECT ex_id, {R('loss')} AS loss, {R('dscore')} AS dscore, weight FROM loss_{name}")
    def loss(spark, sf):
        out = losses_for(spark, sf, name)
        return out.select("ex_id", rnd("loss").alias("loss"), rnd("dscore").alias("dscore"), "weight")

    @case(f"forward_{name}", f"SELECT {R('sum(loss) / sum(weight)')} AS loss, {R('sum(weight)', 4)} AS total_weight FROM loss_{name}")
    def forward(spark, sf):
        return G.forward(losses_for(spark, sf, name)).select(rnd("loss").alias("loss"), rnd("total_weight", 4).alias("total_weight"))

    @case(
        f"backward_{name}",
        f"""SELECT fea_id AS idx, {R(f'sum(value * dscore) / (SELECT sum(weight) FROM loss_{name})', 9)} AS g
        FROM fea JOIN loss_{name} USING (ex_id) GROUP BY 1""",
    )
    def backward(spark, sf):
        total = examples_for(spark, sf, name).agg(F.sum("weight")).first()[0]
        out = G.backward_vector(fea(spark, sf), losses_for(spark, sf, name), total)
        return out.select("idx", rnd("g", 9).alias("g"))

    @case(
        f"linear_{name}",
        f"""SELECT idx, {R('g', 9)} AS g, {R(f'(SELECT sum(loss) / sum(weight) FROM loss_{name})')} AS value FROM grad_{name}""",
    )
    def objective(spark, sf):
        """Value and gradient as one call, over cached batch tables."""
        size = dim(spark, sf)
        cycle = BatchCycle(examples_for(spark, sf, name), fea(spark, sf))
        value, grad = O.LinearModel(cycle, size, POINT[name][0]).value_grad(w0(spark, sf))
        return grad.select("idx", rnd("g", 9).alias("g"), rnd(F.lit(value)).alias("value"))


for _name in POINT:
    _loss_case(_name)


@case("linear_l2_value_only", f"SELECT {R('sum(loss) / sum(weight)')} AS value FROM loss_l2")
def linear_l2_value_only(spark, sf):
    """The value alone needs no gradient pass."""
    return G.forward(losses_for(spark, sf, "l2")).select(rnd("loss").alias("value"))


@case("softmax", f"SELECT ex_id, k, {R('prob')} AS prob FROM mprob")
def softmax(spark, sf):
    wide = S.score_linear_multi(fea_emb(spark, sf), m0(spark, sf), CLASSES, EMBED_DIM)
    return G.softmax_long(wide, CLASSES).select("ex_id", "k", rnd("prob").alias("prob"))


@case(
    "softmax_jacobian",
    f"""SELECT a.ex_id, a.k AS i, b.k AS k, {R('a.prob * (CASE WHEN a.k = b.k THEN 1 ELSE 0 END - b.prob)')} AS jac
    FROM mprob a JOIN mprob b ON a.ex_id = b.ex_id""",
)
def softmax_jacobian(spark, sf):
    wide = S.score_linear_multi(fea_emb(spark, sf), m0(spark, sf), CLASSES, EMBED_DIM)
    return G.softmax_jacobian(wide, CLASSES).select("ex_id", "i", "k", rnd("jac").alias("jac"))


def multi_losses(spark, sf):
    wide = S.score_linear_multi(fea_emb(spark, sf), m0(spark, sf), CLASSES, EMBED_DIM)
    return G.multilabel_losses(G.wide_targets(ex_multi(spark, sf), CLASSES), wide, CLASSES)


@case(
    "loss_softmax_multilabel",
    f"""SELECT s.ex_id, s.k, {R('l.loss')} AS loss, {R('s.dscore')} AS dscore FROM mslope s JOIN mloss l ON s.ex_id = l.ex_id""",
)
def loss_softmax_multilabel(spark, sf):
    out = multi_losses(spark, sf)
    slopes = F.array(*[F.col(f"dscore{i}") for i in range(CLASSES)])
    rows = out.select("ex_id", "loss", F.posexplode(slopes).alias("k", "dscore"))
    return rows.select("ex_id", "k", rnd("loss").alias("loss"), rnd("dscore").alias("dscore"))


@case("forward_softmax", f"SELECT {R('sum(loss) / sum(weight)')} AS loss, {R('sum(weight)', 4)} AS total_weight FROM mloss")
def forward_softmax(spark, sf):
    return G.forward(multi_losses(spark, sf)).select(rnd("loss").alias("loss"), rnd("total_weight", 4).alias("total_weight"))


CTES["mgrad"] = """SELECT f.fea_id AS idx, s.k, sum(f.value * s.dscore) / (SELECT sum(weight) FROM mloss) AS g
  FROM fea_emb f JOIN mslope s ON f.ex_id = s.ex_id GROUP BY 1, 2"""


@case("backward_mat", f"SELECT idx, k, {R('g', 7)} AS g FROM mgrad")
def backward_mat(spark, sf):
    total = float(rows_of(spark, sf, "embeddings"))
    out = G.backward_matrix(fea_emb(spark, sf), multi_losses(spark, sf), CLASSES, total)
    return out.select("idx", "k", rnd("g", 7).alias("g"))


@case("linear_softmax", f"SELECT idx, k, {R('g', 7)} AS g, {R('(SELECT sum(loss) / sum(weight) FROM mloss)')} AS value FROM mgrad")
def linear_softmax(spark, sf):
    cycle = BatchCycle(G.wide_targets(ex_multi(spark, sf), CLASSES), fea_emb(spark, sf))
    value, grad = O.linear_softmax(cycle, EMBED_DIM, CLASSES).value_grad(m0(spark, sf))
    return grad.select("idx", "k", rnd("g", 7).alias("g"), rnd(F.lit(value)).alias("value"))


@case("linear_softmax_long", f"SELECT idx, k, {R('g', 7)} AS g, {R('(SELECT sum(loss) / sum(weight) FROM mloss)')} AS value FROM mgrad")
def linear_softmax_long(spark, sf):
    """The same objective with classes as rows."""
    cycle = BatchCycle(ex_multi(spark, sf), fea_emb(spark, sf))
    value, grad = O.linear_softmax_long(cycle, EMBED_DIM, CLASSES).value_grad(m0(spark, sf))
    return grad.select("idx", "k", rnd("g", 7).alias("g"), rnd(F.lit(value)).alias("value"))


@case(
    "linear_softmax_many_classes",
    f"""SELECT x.idx, x.k, {R('coalesce(g.g, 0)', 9)} AS g, {R('(SELECT sum(loss) / sum(weight) FROM many_loss)')} AS value
    FROM many_x x LEFT JOIN many_grad g ON g.idx = x.idx AND g.k = x.k""",
)
def linear_softmax_many_classes(spark, sf):
    """Value and gradient over two thousand classes."""
    targets, features, x = many_classes(spark, sf)
    value, grad = O.linear_softmax_long(BatchCycle(targets, features), 26, MANY).value_grad(x)
    return grad.select("idx", "k", rnd("g", 9).alias("g"), rnd(F.lit(value)).alias("value"))


@case(
    "objective_lincomb",
    f"""SELECT idx, {R('0.8 * g + 0.05 * v', 8)} AS g,
    {R('0.8 * (SELECT sum(loss) / sum(weight) FROM loss_l2) + 0.05 * 0.5 * (SELECT sum(v * v) FROM w0)')} AS value
    FROM grad_l2 JOIN w0 USING (idx)""",
)
def objective_lincomb(spark, sf):
    model = O.linear_l2(BatchCycle(ex_reg(spark, sf), fea(spark, sf)), dim(spark, sf))
    value, grad = O.Combined(0.8, model, 0.05, O.L2Penalty()).value_grad(w0(spark, sf))
    return grad.select("idx", rnd("g", 8).alias("g"), rnd(F.lit(value)).alias("value"))


@case("reg_l2", f"SELECT idx, {R('v')} AS g, {R('(SELECT 0.5 * sum(v * v) FROM w0)')} AS value FROM w0")
def reg_l2(spark, sf):
    value, grad = O.L2Penalty().value_grad(w0(spark, sf))
    return grad.select("idx", rnd("g").alias("g"), rnd(F.lit(value)).alias("value"))


@case("reg_l1", f"SELECT idx, {R('sign(v)')} AS g, {R('(SELECT sum(abs(v)) FROM w0)')} AS value FROM w0")
def reg_l1(spark, sf):
    value, grad = O.L1Penalty().value_grad(w0(spark, sf))
    return grad.select("idx", rnd("g").alias("g"), rnd(F.lit(value)).alias("value"))
