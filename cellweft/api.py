"""The analysis as one chain of calls on CellData: each takes the container and gives a new one (or a table).

    data = set_codex(protein, blanks, size, spatial)
    data = clean_codex(filter_codex(data), "gaussian")
    scores = adj_score_clusters_codex(cluster_codex(knn_codex(data)), k=3)

Nothing is computed before a table is used, except where a fit or a loop needs a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.frames import CellData, to_dense, to_long
from cellweft.operators import adjacency, clustering, embedding, mapping, mixtures, qc, transfer, views
from cellweft.operators.knn import knn
from cellweft.session import stored
from cellweft.sources import fcs, tabular

# Containers


def _named(n: int, names: Sequence[str] | None, prefix: str) -> tuple[str, ...]:
    return tuple(names) if names else tuple(f"{prefix}{i}" for i in range(1, n + 1))


def _width(df: DataFrame) -> int:
    row = df.select(F.size("vec")).first()
    return row[0] if row else 0


def set_codex(protein: DataFrame, blanks: DataFrame, size: DataFrame, spatial: DataFrame | None = None, names: Sequence[str] | None = None, data: CellData | None = None) -> CellData:
    """Imaging tables: protein (cell_id, vec), blanks (cell_id, blanks), size (cell_id, size), spatial (cell_id, x, y, z)."""
    return (data or CellData()).but(codex_protein=protein, codex_features=_named(_width(protein), names, "CODEXprotein"), codex_blanks=blanks, codex_size=size, codex_spatial=spatial)


def set_cite(mrna: DataFrame, protein: DataFrame, mrna_norm: DataFrame | None = None, latent: DataFrame | None = None, names: Sequence[str] | None = None, data: CellData | None = None) -> CellData:
    """Reference tables: mrna and mrna_norm long (cell_id, feature, value), protein and latent (cell_id, vec). Without mrna_norm it is the log of 10,000 times the share."""
    if mrna_norm is None:
        total = mrna.groupBy("cell_id").agg(F.sum("value").alias("_t"))
        mrna_norm = mrna.join(total, "cell_id").select("cell_id", "feature", F.log1p(F.lit(1e4) * F.when(F.col("_t") == 0, F.lit(float("nan"))).otherwise(F.col("value") / F.col("_t"))).alias("value"))
    return (data or CellData()).but(cite_mrna=mrna, cite_protein=protein, cite_mrna_norm=mrna_norm, cite_latent=latent, cite_features=_named(_width(protein), names, "CITEprotein"))


def import_reference(mrna: DataFrame, protein: DataFrame, *, scaled: DataFrame | None = None, clusters: DataFrame | None = None, latent: DataFrame | None = None, latent_dims: int = 20, emb: DataFrame | None = None, names: Sequence[str] | None = None) -> CellData:
    """A reference data set as another tool exports it: counts, scaled expression, clusters, the first latent_dims latent dimensions, an embedding."""
    data = set_cite(mrna, protein, scaled, None if latent is None else tabular.first_latent(latent, latent_dims), names)
    return data.but(cite_clusters=clusters, cite_emb=emb)


read_codex_fcs = fcs.codex_from_fcs
read_names_fcs = fcs.read_names

# Quality control and cleaning


def filter_codex(data: CellData, size_lim=None, blank_upper=None, blank_lower=None) -> CellData:
    """Gates the imaging cells; sizes, blanks, positions, clusters and embedding follow."""
    data.need("codex_protein", "codex_size", "codex_blanks")
    n = data.codex_blanks.select(F.size("blanks")).first()
    cells = data.codex_size.select("cell_id", "size").join(data.codex_blanks.select("cell_id", "blanks"), "cell_id")
    kept = stored(qc.gate(cells, n[0] if n else 0, size_lim, blank_upper, blank_lower).select("cell_id"), "gated")
    follow = ("codex_protein", "codex_size", "codex_blanks", "codex_spatial", "codex_clusters", "codex_emb")
    return data.but(**{f: getattr(data, f).join(kept, "cell_id", "left_semi") for f in follow if getattr(data, f) is not None})


def filter_cite_mrna(data: CellData, min_transcripts: float = 1200, min_cells_per_gene: int = 30) -> CellData:
    data.need("cite_mrna")
    return data.but(cite_mrna=qc.filter_counts(data.cite_mrna, min_transcripts, min_cells_per_gene))


def clean_codex(data: CellData, model: str = "gaussian", **options) -> CellData:
    data.need("codex_protein")
    long = to_long(data.codex_protein, data.codex_features)
    return data.but(codex_clean=to_dense(mixtures.clean_codex(long, model, **options), data.codex_features))


def clean_cite(data: CellData, model: str = "nb", **options) -> CellData:
    data.need("cite_protein")
    long = to_long(data.cite_protein, data.cite_features)
    return data.but(cite_clean=to_dense(mixtures.clean_cite(long, model, **options), data.cite_features))


# Mapping and transfer


def _pick(df: DataFrame, have: Sequence[str], want: Sequence[str]) -> DataFrame:
    at = [list(have).index(w) for w in want]
    return df.select("cell_id", F.array(*[F.col("vec")[i] for i in at]).alias("vec"))


def map_codex_to_cite(data: CellData, num_chunks: int = 1, seed: int = 0, **options) -> CellData:
    """corrected_codex: the cleaned imaging proteins moved onto the cleaned reference proteins, over the features both have."""
    data.need("cite_clean", "codex_clean", "cite_latent")
    shared = qc.common_features(data.cite_features, data.codex_features)
    out = mapping.correct_in_chunks(_pick(data.cite_clean, data.cite_features, shared), _pick(data.codex_clean, data.codex_features, shared), data.cite_latent, len(shared), num_chunks, seed, **options)
    return data.but(corrected_codex=out, corrected_features=tuple(shared))


def get_transfer_matrix(data: CellData, k_cite: int | None = None, c_cite: float = 0.1, *, transfer_rna: bool = True, fastknn: bool = False) -> CellData:
    """transfer_matrix, and along it the transcripts and clusters of the imaging cells; fastknn takes clusters from neighbours' votes alone."""
    data.need("cite_clean", "corrected_codex")
    ref = _pick(data.cite_clean, data.cite_features, data.corrected_features)
    if fastknn:
        data.need("cite_clusters")
        k = max(1, data.corrected_codex.count() // 500 if k_cite is None else k_cite)
        return data.but(codex_clusters=transfer.neighbour_vote(ref, data.corrected_codex, data.cite_clusters, k))
    t = stored(transfer.transfer_matrix(ref, data.corrected_codex, k_cite, c_cite), "transfer")
    out = data.but(transfer_matrix=t)
    if transfer_rna and data.cite_mrna is not None:
        out = out.but(codex_mrna=transfer.transfer_features(t, data.cite_mrna))
    if data.cite_clusters is not None:
        out = out.but(codex_clusters=transfer.transfer_clusters(t, data.cite_clusters, data.corrected_codex))
    return out


# Clusters


def _codex_vectors(data: CellData) -> DataFrame:
    if data.codex_clean is None:
        data.need("codex_protein")
    return data.codex_clean if data.codex_clean is not None else data.codex_protein


def knn_codex(data: CellData, k: int = 5) -> CellData:
    return data.but(codex_knn=stored(clustering.knn_codex(_codex_vectors(data), k), "knn"))


def cluster_codex(data: CellData, k: int | None = None) -> CellData:
    data.need("codex_knn")
    return data.but(codex_clusters=clustering.louvain(clustering.graph_edges(data.codex_knn, k)))


def parameter_scan(data: CellData, min_cluster_sizes: list[int], min_samples: list[int]) -> CellData:
    data.need("cite_latent")
    runs, labels = clustering.parameter_scan(data.cite_latent, min_cluster_sizes, min_samples)
    return data.but(scan={"runs": runs, "labels": labels})


def consensus_cluster(data: CellData, silhouette_cutoff: float, inconsistent_value: float = 0.3, min_cluster_size: int = 10) -> CellData:
    if not data.scan:
        raise ValueError("not available yet: scan")
    out = clustering.consensus_cluster(data.scan["runs"], data.scan["labels"], data.cite_latent.select("cell_id"), silhouette_cutoff, inconsistent_value, min_cluster_size)
    return data.but(cite_clusters=out)


def get_umap_codex(data: CellData, n_neighbours: int = 30, **options) -> CellData:
    emb, nn = embedding.layout(_codex_vectors(data), n_neighbours, **options)
    return data.but(codex_emb=emb, codex_knn=nn)


def get_umap_cite(data: CellData, n_neighbours: int = 30, **options) -> CellData:
    data.need("cite_latent")
    return data.but(cite_emb=embedding.layout(data.cite_latent, n_neighbours, **options)[0])


def cluster_names(clusters: DataFrame, names: dict[str, str]) -> DataFrame:
    """(cell_id, cluster, name): names for some clusters, the cluster itself for the others."""
    c = F.col("cluster").cast("string")
    name = F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in names.items()], c)
    return clusters.select("cell_id", "cluster", name.alias("name"))


# Adjacency


def _graph(data: CellData, k: int) -> DataFrame:
    data.need("codex_spatial")
    return stored(adjacency.knn_graph(data.codex_spatial, k), "edges")


def adj_score_clusters_codex(data: CellData, k: int) -> DataFrame:
    """(f, g, score, p, q) of exclusive clusters, hypergeometric null."""
    data.need("codex_clusters")
    if data.codex_clusters.select("cluster").distinct().limit(2).count() < 2:
        raise ValueError("at least two clusters are needed")
    return adjacency.with_q_values(adjacency.cluster_p_values(_graph(data, k), data.codex_clusters))


def _permuted(edges: DataFrame, long: DataFrame, pairs: DataFrame, c: float, num_perms: int, estimate: bool, seed: int) -> DataFrame:
    long = stored(long, "long")
    s = adjacency.null_moments(edges, long, pairs, c) if estimate else adjacency.permuted_scores(edges, long, pairs, c, num_perms, seed)
    return adjacency.with_q_values(adjacency.with_p_values(s, num_perms, estimate))


def adj_score_clusters_cite(data: CellData, k: int, c: float = 0.0, num_perms: int = 1000, perm_estimate: bool = True, seed: int = 0) -> DataFrame:
    """(f, g, score, …, p, q) of the reference clusters by how much of each reaches a cell."""
    data.need("cite_clusters", "transfer_matrix")
    m = transfer.soft_membership(data.transfer_matrix, data.cite_clusters).select("cell_id", F.col("cluster").alias("feature"), F.col("weight").alias("value"))
    m = stored(m, "soft")
    names = m.select("feature").distinct()
    if names.limit(2).count() < 2:
        raise ValueError("at least two clusters are needed")
    return _permuted(_graph(data, k), m, adjacency.all_pairs(names), c, num_perms, perm_estimate, seed)


def adj_score_proteins(data: CellData, protein_pairs: DataFrame | None = None, k: int = 5, c: float = 0.0, num_perms: int = 1000, perm_estimate: bool = True, use: str = "raw", seed: int = 0) -> DataFrame:
    """(f, g, score, …, p, q) of protein pairs, on raw intensities (use="clean" for cleaned ones)."""
    data.need("codex_protein")
    long = to_long(data.codex_clean if use == "clean" else data.codex_protein, data.codex_features)
    spark = data.codex_protein.sparkSession
    pairs = protein_pairs if protein_pairs is not None else adjacency.all_pairs(spark.createDataFrame([(f,) for f in data.codex_features], "feature string"))
    return _permuted(_graph(data, k), qc.only_features(long, pairs), pairs, c, num_perms, perm_estimate, seed)


def adj_score_genes(data: CellData, gene_pairs: DataFrame, k: int = 5, c: float = 0.0, num_perms: int = 1000, perm_estimate: bool = True, seed: int = 0) -> DataFrame:
    """(f, g, score, …, p, q) of gene pairs on log(1 + 1000 x) of the transferred transcripts."""
    data.need("codex_mrna")
    long = qc.only_features(data.codex_mrna, gene_pairs).withColumn("value", F.log1p(F.lit(1000.0) * F.col("value")))
    return _permuted(_graph(data, k), long, gene_pairs, c, num_perms, perm_estimate, seed)


def adj_score_heatmap(scores: DataFrame, features: list[str], scaling: float = 1e-10) -> DataFrame:
    return adjacency.heatmap(scores, features, scaling)


# Views


def plot_expr_cite(data: CellData, names: Sequence[str], kind: str = "RNA") -> DataFrame:
    data.need("cite_emb")
    long = data.cite_mrna_norm if kind == "RNA" else to_long(data.cite_protein, data.cite_features)
    return views.expression(data.cite_emb, long, names)


def _codex_long(data: CellData, kind: str) -> DataFrame:
    if kind == "RNA":
        data.need("codex_mrna")
        return data.codex_mrna
    return to_long(_codex_vectors(data), data.codex_features)


def plot_expr_codex_emb(data: CellData, names: Sequence[str], kind: str = "protein") -> DataFrame:
    data.need("codex_emb")
    return views.expression(data.codex_emb, _codex_long(data, kind), names)


def plot_expr_codex_spatial(data: CellData, names: Sequence[str], kind: str = "protein") -> DataFrame:
    data.need("codex_spatial")
    return views.expression_spatial(data.codex_spatial, _codex_long(data, kind), names)


def plot_cluster_cite(data: CellData) -> DataFrame:
    data.need("cite_emb")
    return views.clusters(data.cite_emb, data.cite_clusters)


def plot_cluster_codex_emb(data: CellData) -> DataFrame:
    data.need("codex_emb")
    return views.clusters(data.codex_emb, data.codex_clusters)


def plot_cluster_codex_spatial(data: CellData) -> DataFrame:
    data.need("codex_spatial")
    return views.clusters_spatial(data.codex_spatial, data.codex_clusters)


def plot_index_cite(data: CellData, cell_id) -> DataFrame:
    data.need("cite_emb")
    return views.marked(data.cite_emb, cell_id)


def plot_index_codex_emb(data: CellData, cell_id) -> DataFrame:
    data.need("codex_emb")
    return views.marked(data.codex_emb, cell_id)


def plot_index_codex_spatial(data: CellData, cell_id) -> DataFrame:
    data.need("codex_spatial")
    return views.marked_spatial(data.codex_spatial, cell_id)


def nearest_reference(data: CellData, k: int) -> DataFrame:
    """(q, d, rank, dist): each corrected imaging cell's k nearest reference cells by correlation."""
    data.need("cite_clean", "corrected_codex")
    return knn(_pick(data.cite_clean, data.cite_features, data.corrected_features), data.corrected_codex, k)
