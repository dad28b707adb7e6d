"""Scenario and ensemble analytics on Spark DataFrames.

Describe a model as named indexes (constants, series, random quantities, categories, formulas), make a Scenario of it,
and evaluate it over parameters, weighted scenarios and time. Every value is a relation keyed by the axes on which it
varies; an Evaluation plans DataFrames and nothing runs until a frame or an array of its result is asked for.
"""

from axiloom.axes import DOMAIN, ENSEMBLE, PARAMETER, TIME, Axis, AxisRole
from axiloom.functions.distributions import Distribution
from axiloom.functions.registry import Function, Functor, LambdaAdapter, adapt
from axiloom.index import (
    CategoricalIndex,
    ConditionalCategoricalIndex,
    ConditionalDistributionIndex,
    ConstIndex,
    ConstTimeseriesIndex,
    DistributionIndex,
    DomainValue,
    GenericIndex,
    Index,
    TimeseriesIndex,
)
from axiloom.model import AbstractIndexNotInInputsWarning, InputsContractWarning, IOProxy, Model, ModelContractWarning, ModelVariant
from axiloom.operators.evaluate import Evaluation, EvaluationPlan, EvaluationResult, Region, RegionGuard
from axiloom.plans.expr import HasNode, Node
from axiloom.scenario import Scenario
from axiloom.sources.ensembles import (
    AxisEnsemble,
    CrossProductEnsemble,
    DistributionEnsemble,
    Ensemble,
    EnsembleAxisSpec,
    FrameEnsemble,
    PartitionedEnsemble,
    RowsEnsemble,
    SideBySide,
    WeightedScenario,
    sample_across,
    sample_frame,
)
from axiloom.sources.frames import BoundFrame
from axiloom.streaming.handles import AsyncEvaluationHandle, EvaluationHandle

__all__ = [
    "DOMAIN", "ENSEMBLE", "PARAMETER", "TIME", "AbstractIndexNotInInputsWarning", "AsyncEvaluationHandle", "Axis", "AxisEnsemble", "AxisRole", "BoundFrame",
    "CategoricalIndex", "ConditionalCategoricalIndex", "ConditionalDistributionIndex", "ConstIndex", "ConstTimeseriesIndex", "CrossProductEnsemble",
    "Distribution", "DistributionEnsemble", "DistributionIndex", "DomainValue", "Ensemble", "EnsembleAxisSpec", "Evaluation", "EvaluationHandle", "EvaluationPlan",
    "EvaluationResult", "FrameEnsemble", "Function", "Functor", "GenericIndex", "HasNode", "IOProxy", "Index", "InputsContractWarning", "LambdaAdapter", "Model", "ModelContractWarning",
    "ModelVariant", "Node", "PartitionedEnsemble", "Region", "RegionGuard", "RowsEnsemble", "Scenario", "SideBySide", "TimeseriesIndex", "WeightedScenario", "adapt", "sample_across", "sample_frame",
]
