"""Example subgraphs: reviewed opportunities, architecture documents and a CRM extract, with questions to begin with.

Fields named p_..._ lie on the edge that leads to their class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .extras import file_metadata, win_loss
from .kg import DocumentSubgraph, Subgraph, TableSubgraph, register_subgraph
from .schema import EdgeSpec, GraphSchema, NodeSpec
from .sources.tables import TableSource, read_documents, resolve_column


@dataclass
class Person:
    name: str | None = None
    organization: str | None = None
    contact_type: str | None = None
    p_role_: str | None = None


@dataclass
class Customer:
    name: str
    segment: str | None = None
    employees: list[Person] | None = None


@dataclass
class Opportunity:
    name: str
    opportunity_id: str
    customer: Customer
    status: str | None = None


@dataclass
class FinancialMetrics:
    tcv: float | None = None
    annual_revenue: float | None = None
    project_margin: float | None = None


@dataclass
class CompetitiveLandscape:
    competitive_position: str | None = None
    differentiators: list[str] | None = None


@dataclass
class TechnicalApproach:
    architecture: str | None = None
    technical_stack: list[str] | None = None


@dataclass
class RiskAnalysis:
    p_risk_description_: str
    risk_category: str | None = None
    p_mitigation_strategy_: str | None = None


@dataclass
class Competitor:
    name: str
    known_as: str | None = None
    p_comment_: str | None = None


@dataclass
class Partner:
    name: str
    p_role_: str | None = None


@dataclass
class ReviewedOpportunity:
    opportunity: Opportunity
    tech_stack: TechnicalApproach
    team: list[Person]
    financials: FinancialMetrics
    risks: list[RiskAnalysis]
    competition: CompetitiveLandscape
    start_date: str | None = None
    keywords: list[str] | None = None
    competitors: list[Competitor] | None = None
    partners: list[Partner] | None = None
    metadata: dict[str, str] | None = None


@dataclass
class TechnicalComponent:
    name: str
    type: str
    p_purpose_: str | None = None


@dataclass
class Solution:
    name: str | None = None
    vendor: str | None = None
    type: str | None = None
    p_purpose_: str | None = None


@dataclass
class SWArchitectureDocument:
    opportunity: Opportunity
    document_date: str | None = None
    technical_stack: list[TechnicalComponent] | None = None
    used_solutions: list[Solution] | None = None
    keywords: list[str] | None = None
    metadata: dict[str, str] | None = None


@dataclass
class WinLoss:
    result: str
    reason: str | None = None


@dataclass
class CrmExtract:
    opportunity: Opportunity
    lead: Person
    win_loss: WinLoss
    metadata: dict[str, str] | None = None


def common_nodes(with_win_loss: bool = False) -> list[NodeSpec]:
    return [
        NodeSpec(Opportunity, "name", deduplication_key="opportunity_id", extra=(win_loss(),) if with_win_loss else (), index_fields=("name",), description="A business opportunity"),
        NodeSpec(Customer, "name", index_fields=("name", "segment"), description="A customer organisation"),
        NodeSpec(Person, "name", index_fields=("name",), description="A person, of a customer or the own organisation"),
    ]


def first_of(*names: str, otherwise: str):
    """The first field that holds text."""
    return lambda item, label: F.coalesce(*[F.when(F.trim(item[n].cast("string")) != "", item[n].cast("string")) for n in names], F.lit(otherwise))


def review_schema() -> GraphSchema:
    nodes = [
        *common_nodes(),
        NodeSpec(ReviewedOpportunity, lambda item, label: F.concat(F.lit("Review:"), F.coalesce(item["start_date"], F.lit("None"))), deduplication_key=lambda item, label: item["opportunity"]["opportunity_id"], extra=(file_metadata("metadata"),), embedded=(FinancialMetrics, CompetitiveLandscape), description="A reviewed opportunity"),
        NodeSpec(RiskAnalysis, first_of("risk_category", "p_risk_description_", otherwise="other_risk"), description="A risk and what is done about it"),
        NodeSpec(TechnicalApproach, lambda item, label: F.coalesce(F.when(F.size(item["technical_stack"]) > 0, F.array_join(item["technical_stack"], ", ")), F.when(item["architecture"] != "", item["architecture"]), F.lit(f"{label}_default")), index_fields=("architecture", "technical_stack"), description="How it is to be built"),
        NodeSpec(Competitor, first_of("known_as", "name", otherwise="Competitor"), description="A competitor"),
        NodeSpec(Partner, "name", description="A partner organisation"),
    ]
    edges = [
        EdgeSpec(ReviewedOpportunity, Opportunity, "REVIEWS", "What is reviewed"), EdgeSpec(Opportunity, Customer, "HAS_CUSTOMER", "Whose opportunity it is"),
        EdgeSpec(Customer, Person, "HAS_CONTACT", "Contacts at the customer"), EdgeSpec(ReviewedOpportunity, Person, "HAS_TEAM_MEMBER", "The own team"),
        EdgeSpec(ReviewedOpportunity, Partner, "HAS_PARTNER", "Partners that take part"), EdgeSpec(ReviewedOpportunity, RiskAnalysis, "HAS_RISK", "Risks found"),
        EdgeSpec(ReviewedOpportunity, TechnicalApproach, "HAS_TECH_STACK", "The technical approach"), EdgeSpec(ReviewedOpportunity, Competitor, "HAS_COMPETITOR", "Competitors met"),
    ]
    return GraphSchema(ReviewedOpportunity, nodes, edges)


def architecture_schema() -> GraphSchema:
    nodes = [
        *common_nodes(),
        NodeSpec(SWArchitectureDocument, lambda item, label: F.concat(F.lit("Architecture:"), F.coalesce(item["document_date"], F.lit("unknown"))), extra=(file_metadata("metadata"),), description="An architecture document"),
        NodeSpec(TechnicalComponent, "name", deduplication_key="name", index_fields=("name", "type"), description="A technology, tool or platform"),
        NodeSpec(Solution, "name", deduplication_key="name", index_fields=("name", "vendor", "type"), description="A product or managed service"),
    ]
    edges = [
        EdgeSpec(SWArchitectureDocument, Opportunity, "ARCHITECTURE_OF", "What it was made for"), EdgeSpec(Opportunity, Customer, "HAS_CUSTOMER", "Whose opportunity it is"),
        EdgeSpec(SWArchitectureDocument, TechnicalComponent, "USES_COMPONENT", "Components used"), EdgeSpec(SWArchitectureDocument, Solution, "USES_SOLUTION", "Solutions used"),
    ]
    return GraphSchema(SWArchitectureDocument, nodes, edges)


def crm_schema() -> GraphSchema:
    nodes = [*common_nodes(with_win_loss=True), NodeSpec(CrmExtract, lambda item, label: F.lit(label), deduplication_key=lambda item, label: item["opportunity"]["opportunity_id"], extra=(file_metadata(),), description="What the CRM says of an opportunity")]
    edges = [EdgeSpec(CrmExtract, Opportunity, "CRM_INFO", "The opportunity"), EdgeSpec(Opportunity, Person, "LEAD_BY", "Who leads it"), EdgeSpec(Opportunity, Customer, "FOR_CUSTOMER", "Whose opportunity it is")]
    return GraphSchema(CrmExtract, nodes, edges)


def crm_documents(rows: DataFrame) -> DataFrame:
    """Rows of a CRM extract as CrmExtract documents. The first column whose name ends in "Opportunity ID" is the id."""
    key = next(c for c in rows.columns if c.endswith("Opportunity ID"))

    def text(name: str) -> Column:
        return F.coalesce(F.col(f"`{resolve_column(rows.columns, name)}`").cast("string"), F.lit("")) if name in rows.columns else F.lit("")

    none = F.lit(None).cast("string")
    person = lambda name: F.struct(name.alias("name"), F.lit("own").alias("organization"), none.alias("contact_type"), F.lit("Client Leader").alias("p_role_"))
    employees = F.lit(None).cast("array<struct<name:string,organization:string,contact_type:string,p_role_:string>>")
    customer = F.struct(text("Account Name").alias("name"), text("Sub-Industry").alias("segment"), employees.alias("employees"))
    opportunity = F.struct(text("Opportunity Name").alias("name"), F.col(f"`{key}`").cast("string").alias("opportunity_id"), customer.alias("customer"), none.alias("status"))
    kept = [c for c in ("_key", "_ord") if c in rows.columns]
    return rows.select(*kept, opportunity.alias("opportunity"), person(text("Client Leader")).alias("lead"), F.struct(text("Status").alias("result"), text("Reason").alias("reason")).alias("win_loss"), F.lit(None).cast("map<string,string>").alias("metadata"))


SAMPLE_QUERIES = {
    "ReviewedOpportunity": [
        "MATCH (n) RETURN labels(n)[0] AS label, count(n) AS n",
        "MATCH (o:Opportunity) RETURN o.name, o.status LIMIT 5",
        "MATCH (c:Customer)-[r:HAS_CONTACT]->(p:Person) RETURN c.name, p.name, r.role LIMIT 5",
        "MATCH (x:ReviewedOpportunity)-[r:HAS_RISK]->(k:RiskAnalysis) RETURN k.name, r.risk_description LIMIT 3",
        "MATCH (x:ReviewedOpportunity)-[r:HAS_PARTNER]->(p:Partner) RETURN x.start_date, p.name, r.role",
        "MATCH (o:Opportunity)-[:HAS_CUSTOMER]->(c:Customer) RETURN o.name, c.name, c.segment",
    ],
    "ArchitectureDocument": [
        "MATCH (d:SWArchitectureDocument)-[r:USES_COMPONENT]->(c:TechnicalComponent) RETURN d.name, c.name, c.type, r.purpose LIMIT 10",
        "MATCH (s:Solution)<-[:USES_SOLUTION]-(d:SWArchitectureDocument) RETURN s.vendor AS vendor, count(DISTINCT d) AS documents ORDER BY documents DESC",
    ],
    "CrmExtract": [
        "MATCH (o:Opportunity)-[:FOR_CUSTOMER]->(c:Customer) RETURN c.name, count(o) AS opportunities ORDER BY opportunities DESC",
        "MATCH (o:Opportunity) WHERE o.win_loss.result IS NOT NULL RETURN o.win_loss.result AS result, count(o) AS n",
    ],
}


def register_examples(reviews: str | None = None, architectures: str | None = None, crm: TableSource | None = None) -> list[Subgraph]:
    """Registers the example subgraphs whose sources are given: folders of JSON documents, and an imported CRM table."""
    out: list[Subgraph] = []

    def documents(name: str, schema: GraphSchema, path: str) -> None:
        read = lambda spark: read_documents(spark, path, schema.root)
        out.append(register_subgraph(name, DocumentSubgraph(name, schema, read, SAMPLE_QUERIES[name])))

    if reviews:
        documents("ReviewedOpportunity", review_schema(), reviews)
    if architectures:
        documents("ArchitectureDocument", architecture_schema(), architectures)
    if crm:
        crm.mapper = crm_documents
        read = lambda spark: crm.documents()
        out.append(register_subgraph("CrmExtract", TableSubgraph("CrmExtract", crm_schema(), read, SAMPLE_QUERIES["CrmExtract"], source=crm)))
    return out


def review_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, ReviewedOpportunity)
