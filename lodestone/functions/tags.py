"""Keyword tags from ordered vocabularies (E-04, E-05)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.said import label_kind

# The keywords of what a company builds.
BUILD = {
    "hardware": r"\bdevices?\b|\bsensors?\b|\brobot|\bdrones?\b|\bhardware\b|\bmachines?\b(?! learning)|\bequipment\b|\binstruments?\b|\bbatter(?:y|ies)\b|\bchips?\b|\bsemiconductor|\bvehicles?\b|\bsatellites? (?:bus|payload|constellation|hardware)|\bimplants?\b|\bprosthe|\bwearables?\b|\belectrolys[ez]rs?\b|\bmotors?\b|\b3d[- ]print|\bUAVs?\b|\brockets?\b|\blaunch vehicles?\b|\breactors?\b|\bwheelchairs?\b|\bactuators?\b|\blidar\b|\bradars?\b|\bantennas?\b|\bcircuits?\b|\bmicrofluidic|\bturbines?\b|\bchargers?\b|\binverters?\b|\bthrusters?\b|\bphotonic|\blasers?\b|\bspectromet|\bscanners?\b|\bcartridges?\b|\bpoint[- ]of[- ]care\b|\bsplints?\b|\borthos[ie]s|\bstents?\b|\bcatheters?\b|\bventilators?\b|\bkiosks?\b|\bIoT\b|\bembedded\b|\bmicroscopes?\b|\bROVs?\b|\bexoskeleton|\bpumps?\b|\bgadgets?\b|\bsolar (?:cells?|panels?|modules?)\b|\bsuperconduct|\belectronics\b|\bhumanoids?\b|\bheadbands?\b|\bair handling units?\b|\bcooling systems?\b|\brefrigerat|\bengine control\b|\bpower electronics\b",
    "software": r"\bsoftware\b|\b(?:online|digital|web|mobile|cloud|data|saas|analytics|learning|messaging) platforms?\b|\bmobile app|\bapps?\b|\bSaaS\b|\balgorithms?\b|\banalytics\b|\bcloud\b|\bdashboards?\b|\bapplication programming interface|\bweb[- ]based\b|\bmachine learning\b|\bdeep learning\b|\bartificial intelligence\b|\bAI[- ](?:powered|based|driven|tool|model|platform|system)|\bcomputer vision\b|\bblockchain\b|\bdigital twins?\b|\blarge language models?\b|\bLLMs?\b|\bchatbots?\b|\bmarketplace\b|\bportal\b|\bdesign automation\b|\bsimulation software\b",
    "biological or chemical": r"\bdrugs?\b|\bmolecul|\bvaccin|\bantibod|\benzym|\bbacteri|\bmicrob|\bcell therap|\bformulations?\b|\bbiomaterials?\b|\bferment|\bpeptides?\b|\bproteins?\b|\bprobiotic|\bbiologics?\b|\btherapeutics?\b|\bnanoparticles?\b|\bcatalysts?\b|\bpolymers?\b|\bbio-?fertili|\bbiopesticide|\bnutraceutical|\breagents?\b|\bassays?\b|\bdiagnostic kits?\b|\bhydrogels?\b|\bbiochar\b|\bbioplastic|\bchemicals?\b|\bactive pharmaceutical ingredients?\b|\bgenom|\bCRISPR\b|\bmRNA\b|\bstem cells?\b|\btissue engineer|\bgreen chemistry\b|\bbiosimilar|\bmicroalgae\b",
}
# The keywords of the field it works in.
DOMAIN = {
    "health": r"\bhealth|\bmedical\b|\bpatients?\b|\bclinic|\bhospitals?\b|\bdiseases?\b|\bdiagnos|\btherap|\bsurg|\bcancer|\bcardi|\bneuro|\beye\b|\bophthalm|\bdental\b|\bmaternal\b|\bpharma|\bdrugs?\b|\brehabilit|\bwounds?\b|\binfections?\b|\bdialysis\b|\bneonat|\bsutur|\bparkinson|\bblind\b|\belderly\b|\bdiabet|\binsulin\b|\bkidney|\bdementia\b|\bmicrobiome\b",
    "agriculture & food": r"\bagri|\bfarm|\bcrops?\b|\bsoil\b|\blivestock\b|\bdairy\b|\bpoultry\b|\baquacultur|\bfisher|\bfood\b|\birrigat|\bharvest|\bveterinar|\bcattle\b|\bmillets?\b|\bhydroponic|\bstubble\b|\bcrop residue",
    "energy": r"\benergy\b|\bsolar\b|\bbatter(?:y|ies)\b|\bhydrogen\b|\belectrolys|\bfuel cells?\b|\bgrid\b|\bpower electronics\b|\brenewable|\bwind (?:energy|power|turbine)|\bcharging\b|\bthermal storage\b",
    "mobility": r"\belectric vehicles?\b|\bEVs?\b|\b(?:e-|electric |urban |shared |last[- ]mile )mobility\b|\bautomotive\b|\btwo-wheelers?\b|\btransport|\brailways?\b|\btraffic\b",
    "space & aerospace": r"\bspace (?:tech|mission|sector|industry|economy|debris|situational)|\bspacecraft\b|\bouter space\b|\bsatellites?\b|\baerospace\b|\brockets?\b|\blaunch vehicles?\b|\borbital\b|\bin orbit\b|\blow earth orbit\b|\baircraft\b|\baviation\b|\bUAVs?\b|\bdrones?\b|\bavionics\b",
    "defence & security": r"\bdefen[cs]e\b|\bmilitary\b|\barmed forces\b|\barmy\b|\bnavy\b|\bsurveillance\b|\bcyber|\bborder\b|\bforensic",
    "water & environment": r"\bwater\b|\bwastewater\b|\bwaste\b|\bpollut|\bair quality\b|\bcarbon (?:capture|footprint|emission|neutral|negative)|\bclimate\b|\bemissions?\b|\brecycl|\bcircular economy\b|\bplastic waste\b|\bsanitation\b|\bdesalinat|\bsewer|\bmanual scavenging\b",
    "manufacturing & industry": r"\bmanufactur|\bindustrial\b|\bfactor(?:y|ies)\b|\bmachining\b|\binspection\b|\bpredictive maintenance\b|\bsupply chains?\b|\bwarehous|\boil and gas\b|\bmining\b|\bsteel\b|\bcement\b",
    "buildings & construction": r"\bconstruction\b|\bbuildings\b|\bbuilding (?:materials?|envelope|sector|industry)\b|\bbuilding-integrated\b|\bgreen building|\bconcrete\b|\bHVAC\b|\bbricks?\b|\bcivil engineering\b",
    "education": r"\beducation|\bstudents?\b|\bschools?\b|\bteach|\bliteracy\b|\blearners?\b|\bskilling\b",
    "finance": r"\bfintech\b|\bfinancial\b|\bpayments?\b|\blending\b|\binsur|\bbanking\b",
}


def tags(text: Column, vocabulary: dict[str, str]) -> Column:
    """The tags whose keywords stand in the text, in the vocabulary's order; none for no text (E-04)."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i)(?:{p})"), F.lit(tag)) for tag, p in vocabulary.items()]))


def described_text(product: Column, identity: Column, description: Column) -> Column:
    """The words that tags are read from: an own sentence on a verified site, and a description that is no label (E-05)."""
    own = F.when(F.coalesce(identity == "verified", F.lit(False)) & (product != ""), product)
    return F.concat_ws(" ", own, F.when((description != "") & label_kind(description).isNull(), description))
